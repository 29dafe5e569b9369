"""Normal distribution helpers as plain column expressions, and t tails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Acklam's rational approximation of the normal quantile.
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00)
PPF_LOW = 0.02425


def half_even(x: Column, decimals: int) -> Column:
    """Round half to even on the scaled binary value, as numpy does."""
    scale = F.lit(float(10**decimals))
    return F.rint(x * scale) / scale


def _horner(x: Column, coefs) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def two_sided_normal_p(z: Column) -> Column:
    """P(|Z| > |z|) for a standard normal."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    return _horner(t, ERF_A[::-1]) * t * F.exp(-x * x)


def normal_cdf(z: Column) -> Column:
    half = two_sided_normal_p(z) / 2
    return F.when(z >= 0, F.lit(1.0) - half).otherwise(half)


def normal_ppf(p: Column) -> Column:
    tail_low = F.sqrt(F.log(p) * -2)
    tail_high = F.sqrt(F.log(F.lit(1.0) - p) * -2)
    mid = p - 0.5
    tail = lambda q: _horner(q, PPF_C) / _horner(q, PPF_D + (1.0,))
    return (
        F.when(p < PPF_LOW, tail(tail_low))
        .when(p > 1 - PPF_LOW, -tail(tail_high))
        .otherwise(_horner(mid * mid, PPF_A) * mid / _horner(mid * mid, PPF_B + (1.0,)))
    )


# Lanczos approximation of the gamma function (g = 7, nine terms).
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x of at least 0.5."""
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:]):
        series = series + F.lit(c) / (x + k)
    t = x + (LANCZOS_G - 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(t) - t + F.log(series)


# More steps than the fraction needs at any number of degrees: it converges in about sqrt(dof).
FRACTION_STEPS = 400


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz), as one fold."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + m * 2 - 1) * (a + m * 2))
        odd = -(a + m) * (a + b + m) * x / ((a + m * 2) * (a + m * 2 + 1))
        num = F.when(k % 2 == 0, even).otherwise(odd)
        d = F.lit(1.0) / tiny(num * s["d"] + 1.0)
        c = tiny(num / s["c"] + 1.0)
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    first = F.struct(F.lit(1e300).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), first, step, lambda s: s["h"])


def two_sided_t_p(t: Column | str, dof: Column | str) -> Column:
    """P(|T| > |t|) of Student's t, by the incomplete beta function; null without degrees of freedom."""
    t, dof = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (t, dof))
    a, b, x = dof / 2, F.lit(0.5), dof / (dof + t * t)
    front = F.exp(log_gamma(a + 0.5) - log_gamma(a) - F.lit(0.5 * math.log(math.pi)) + a * F.log(x) + F.log1p(-x) * 0.5)
    low = x < (a + 1) / (a + 2.5)
    part = _beta_fraction(F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(F.lit(1.0) - x))
    p = F.when(low, front * part / a).otherwise(F.lit(1.0) - front * part / b)
    return F.when(dof > 0, F.when(x >= 1, F.lit(1.0)).otherwise(p))

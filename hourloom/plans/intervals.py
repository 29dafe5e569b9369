"""Prediction intervals: fixed bands and split-conformal widening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantile import quantiles
from ..session import KEY

# Target coverage and the P10 / P90 offsets of the two models.
TARGET_COVERAGE = 0.80
BANDS = {"context": (-0.62, 0.61), "trees": (-0.95, 0.93)}


def nonconformity(actual: Column, lower: Column, upper: Column) -> Column:
    """How far outside the interval the actual lies; negative inside."""
    return F.greatest(lower - actual, actual - upper)


def conformal_level(n: Column, target: float = TARGET_COVERAGE) -> Column:
    """Finite-sample quantile level of split-conformal calibration."""
    return F.least(F.ceil((n + 1) * F.lit(target)) / n, F.lit(1.0))


def conformal_offsets(
    calibration: DataFrame,
    keys: Sequence[str] = (KEY,),
    actual: str = "actual",
    lower: str = "lower",
    upper: str = "upper",
    target: float = TARGET_COVERAGE,
) -> DataFrame:
    """Offset per group that widens (or, if negative, narrows) both bounds.

    The level depends on the group size, which the ranked values carry along,
    so no count has to be collected first.
    """
    scored = calibration.withColumn("_score", nonconformity(F.col(actual), F.col(lower), F.col(upper)))
    offsets = quantiles(scored, keys, "_score", [conformal_level(F.col("_n"), target)])
    return offsets.select(*keys, F.col("value").alias("conformal_offset"))


def widen(df: DataFrame, offsets: DataFrame, keys: Sequence[str] = (KEY,), lower="lower", upper="upper") -> DataFrame:
    """Apply the offsets; bounds are not clamped and may cross.

    A group without calibration rows gets the mean offset of the others, or none at all if
    there are no others.
    """
    pooled = offsets.agg(F.avg("conformal_offset").alias("_pooled")).scalar()
    offset = F.coalesce("conformal_offset", pooled, F.lit(0.0))
    return df.join(offsets, list(keys), "left").withColumn("conformal_offset", offset).withColumns({
        lower: F.col(lower) - F.col("conformal_offset"), upper: F.col(upper) + F.col("conformal_offset")})


def const_band(df: DataFrame, band: str = "context", point: str = "pred") -> DataFrame:
    """Point plus fixed offsets wherever no bound is stored."""
    low, high = BANDS[band]
    stored = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("double")
    return df.withColumn("lower_gw", F.coalesce(stored("lower_gw"), F.col(point) + low)).withColumn(
        "upper_gw", F.coalesce(stored("upper_gw"), F.col(point) + high)
    )

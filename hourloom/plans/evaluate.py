"""Residual diagnostics, accuracy tests and interval calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import normal_ppf, two_sided_normal_p, two_sided_t_p
from ..operators.buckets import with_neighbours
from ..operators.quantile import quantiles, ranked_values
from ..session import KEY

# Nominal levels, variance floor and significance level.
LEVELS = [round(0.05 * i, 2) for i in range(1, 20)]
VARIANCE_FLOOR = 1e-12
ALPHA = 0.05


def residuals(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("residual", F.col("actual") - F.col("pred"))


def plotting_position(rank: Column, n: Column) -> Column:
    """Filliben's estimate of the median of the rank-th order statistic."""
    top = F.pow(F.lit(0.5), F.lit(1.0) / n)
    return F.when(rank == n, top).when(rank == 1, F.lit(1.0) - top).otherwise((rank - 0.3175) / (n + 0.365))


def qq_points(df: DataFrame, value: str = "residual", keys=(KEY,)) -> DataFrame:
    """Normal Q-Q points ``(rank, theoretical, ordered)``.

    Ranks come from the range-split distributed rank; equal values travel as one
    row with a count and are unfolded at the end.
    """
    ranked = ranked_values(df, keys, value)
    first, last = F.col("_before") + 1, F.col("_before") + F.col("_count")
    points = ranked.select(*keys, F.col("_value").alias("ordered"), "_n", F.explode(F.sequence(first, last)).alias("rank"))
    return points.select(
        *keys, "rank", normal_ppf(plotting_position(F.col("rank"), F.col("_n"))).alias("theoretical"), "ordered"
    )


def qq_fit(points: DataFrame, keys=(KEY,)) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"),
        F.corr("ordered", "theoretical").alias("r"),
    )


def loss_differential(paired: DataFrame, e1: Column, e2: Column) -> DataFrame:
    """Squared-loss difference; negative where the first model is better."""
    return paired.withColumn("d", e1 * e1 - e2 * e2)


def diebold_mariano(diffs: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """Test per series with variance gamma0 + 2 gamma1, floored, and a normal p-value."""
    rows = with_neighbours(diffs.select(KEY, "ts", "d"), ["d"], side="prev")
    stats = rows.groupBy(KEY).agg(
        F.count("d").alias("n"),
        F.avg("d").alias("d_bar"),
        F.var_samp("d").alias("gamma0"),
        F.coalesce(F.covar_samp("d", F.col("_prev.d")), F.lit(0.0)).alias("gamma1"),
    )
    variance = (F.col("gamma0") + F.col("gamma1") * 2) / F.col("n")
    dm = stats.withColumn("dm_stat", F.col("d_bar") / F.sqrt(F.greatest(variance, F.lit(VARIANCE_FLOOR))))
    return dm.withColumn("p_value", two_sided_normal_p(F.col("dm_stat"))).withColumns({
        "reject": F.col("p_value") < ALPHA,
        "verdict": F.when(
            (F.col("dm_stat") < 0) & (F.col("p_value") < ALPHA), f"{first} significantly outperforms {second}"
        ).otherwise("No statistically significant difference"),
    })


def diebold_mariano_simple(paired: DataFrame) -> DataFrame:
    """Oracle against recursive errors (3 decimals), no autocovariance, t(n-1) p-value.

    ``paired`` has ``actual, oracle, recursive`` per series and hour.
    """
    err = lambda name: F.round(F.round(name, 3) - F.round("actual", 3), 3)
    d = err("oracle") * err("oracle") - err("recursive") * err("recursive")
    stats = paired.withColumn("d", d).groupBy(KEY).agg(
        F.count("d").alias("n"), F.avg("d").alias("dm_mean"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("dm_se")
    )
    out = stats.withColumn(
        "dm_statistic", F.when(F.col("dm_se") > 0, F.col("dm_mean") / F.col("dm_se")).otherwise(0.0)
    )
    p, mean = F.col("dm_pvalue"), F.col("dm_mean")
    shown = F.format_string("%.4f", p)
    return out.withColumn("dm_pvalue", two_sided_t_p(F.abs("dm_statistic"), F.col("n") - 1)).withColumn(
        "dm_note",
        F.when((p < 0.01) & (mean < 0), F.lit("Oracle significantly more accurate (p<0.01)"))
        .when((p < 0.05) & (mean < 0), F.concat(F.lit("Oracle marginally better (p="), shown, F.lit(")")))
        .when((p < 0.05) & (mean > 0), F.concat(F.lit("Recursive outperforms oracle (p="), shown, F.lit(")")))
        .otherwise(F.concat(F.lit("No significant difference (p="), shown, F.lit(")"))),
    )


def calibration_curve(df: DataFrame, value: str = "residual", keys=(KEY,), levels=LEVELS) -> DataFrame:
    """Empirical coverage of central residual intervals at each nominal level.

    Coverage follows from the ranks at the interval ends, so residuals are not
    read again per level.
    """
    halves = [(level, (1 - level) / 2) for level in levels]
    ends = quantiles(df, keys, value, [q for _, h in halves for q in (h, 1 - h)])
    nominal = F.create_map(*[F.lit(x) for level, h in halves for q in (h, 1 - h) for x in (q, level)])
    low = F.create_map(*[F.lit(x) for _, h in halves for q in (h, 1 - h) for x in (q, q == h)])
    marked = ends.withColumn("nominal", nominal[F.col("level")]).withColumn("_low", low[F.col("level")])
    pick = lambda name, is_low: F.max(F.when(F.col("_low") == is_low, F.col(name)))
    return marked.groupBy(*keys, "nominal").agg(
        pick("value", True).alias("lo"),
        pick("value", False).alias("hi"),
        ((pick("n_upto", False) - pick("n_below", True)) / F.max("n")).alias("empirical"),
    )


def calibration_curve_held_out(df: DataFrame, fit_rows: Column, value: str = "residual", keys=(KEY,), levels=LEVELS) -> DataFrame:
    """As above with quantiles from one part of the rows and coverage from the other."""
    curve = calibration_curve(df.where(fit_rows), value, keys, levels)
    ends = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nominal", "lo", "hi"))).alias("_ends"))
    rest = df.where(~fit_rows).join(ends, list(keys))
    inside = [
        F.avg(((F.col(value) >= F.col("_ends")[i]["lo"]) & (F.col(value) <= F.col("_ends")[i]["hi"])).cast("double"))
        for i in range(len(levels))
    ]
    wide = rest.groupBy(*keys).agg(*[c.alias(str(level)) for c, level in zip(inside, levels)])
    return wide.unpivot(list(keys), [F.col(f"`{level}`") for level in levels], "nominal", "empirical").withColumn(
        "nominal", F.col("nominal").cast("double")
    )


def at_level(curve: DataFrame, target: float = 0.80, keys=(KEY,)) -> DataFrame:
    """The curve point whose nominal level is nearest the target."""
    nearest = F.struct(F.abs(F.col("nominal") - target), "nominal")
    return curve.groupBy(*keys).agg(
        F.min_by("nominal", nearest).alias("nominal"), F.min_by("empirical", nearest).alias("empirical")
    )

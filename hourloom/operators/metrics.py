"""Error metrics, coverage, profiles and histograms; all combine map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import KEY
from .buckets import with_neighbours


def mae(actual: Column, pred: Column) -> Column:
    return F.avg(F.abs(actual - pred))


def rmse(actual: Column, pred: Column) -> Column:
    return F.sqrt(F.avg((actual - pred) * (actual - pred)))


def mape(actual: Column, pred: Column) -> Column:
    """Mean absolute percentage error over rows with a non-zero actual."""
    return F.avg(F.when(actual != 0, F.abs((actual - pred) / actual))) * 100


def mape_all_rows(actual: Column, pred: Column) -> Column:
    """Variant dividing by every row, zero actuals included."""
    return F.sum(F.when(actual != 0, F.abs(actual - pred) / actual * 100).otherwise(0.0)) / F.count("*")


def coverage(actual: Column, lower: Column, upper: Column) -> Column:
    """Percentage of actuals inside the closed interval."""
    return F.avg(((actual >= lower) & (actual <= upper)).cast("double")) * 100


def error_metrics(actual: Column, pred: Column) -> list[Column]:
    return [mae(actual, pred).alias("mae"), rmse(actual, pred).alias("rmse"), mape(actual, pred).alias("mape")]


def metrics_by_model(predictions: DataFrame, keys: Sequence[str] = (KEY, "model")) -> DataFrame:
    return predictions.groupBy(*keys).agg(*error_metrics(F.col("actual"), F.col("pred")))


def compare_models(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per series with the metrics of each named model side by side."""
    return (
        predictions.groupBy(KEY)
        .pivot("model", list(models))
        .agg(*error_metrics(F.col("actual"), F.col("pred")))
    )


def profile(df: DataFrame, value: str = "demand_gw") -> DataFrame:
    return df.groupBy(KEY).agg(
        F.count("*").alias("n_rows"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def anchors(stored: DataFrame, fresher: DataFrame) -> DataFrame:
    """Last known timestamp per series; the fresher store overrides when it has one."""
    a = stored.groupBy(KEY).agg(F.max("ts").alias("_stored"))
    b = fresher.groupBy(KEY).agg(F.max("ts").alias("_fresh"))
    return a.join(b, KEY, "full").select(KEY, F.coalesce("_fresh", "_stored").alias("anchor_ts"))


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Equal-width bin counts per group, the last bin closed; empty bins are absent.

    Values are counted before they meet the group range, so the join sees
    distinct values only.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    raw = F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width)).otherwise(F.lit(0))
    return (
        counted.join(span, keys)
        .withColumn("bin", F.least(raw, F.lit(bins - 1)).cast("int"))
        .withColumn("bin_lo", F.col("_lo") + F.col("bin") * width)
        .groupBy(*keys, "bin", "bin_lo")
        .agg(F.sum("_c").alias("n"))
    )


def autocov1(df: DataFrame, value: str, keys: Sequence[str] = (KEY,), order: str = "ts") -> DataFrame:
    """Lag-1 sample autocovariance, each side about its own mean."""
    rows = with_neighbours(df.select(*keys, order, value), [value], side="prev", keys=keys, order=order)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.covar_samp(F.col(value), F.col(f"_prev.{value}")), F.lit(0.0)).alias("autocov1")
    )

"""First / last N rows of each series and importance rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import KEYS, present, time_bucket, with_positions


def _edge(df: DataFrame, n: int, keys: Sequence[str], order: str, tie_break: Sequence[str], last: bool) -> DataFrame:
    """The first or last ``n`` rows of every time bucket: all that can be among those of the series.

    Rows of equal time are ordered by ``tie_break`` and then by the other columns, as
    ``with_positions`` orders them.
    """
    rest = [c for c in df.columns if c not in keys and c != order and c not in tie_break]
    row = F.struct(order, *tie_break, *rest)
    near = Window.partitionBy(*keys, "_near").orderBy(row.desc() if last else row)
    ranked = present(df, [*keys, order]).withColumn("_near", time_bucket(order)).withColumn("_rn", F.row_number().over(near))
    return ranked.where(f"_rn <= {n}").drop("_rn", "_near")


def tail(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: str = "ts", tie_break: Sequence[str] = ()) -> DataFrame:
    """Last ``n`` rows by time of every series; rows without key or time are no part of it."""
    few = _edge(df, n, keys, order, tie_break, last=True)
    return with_positions(few, keys, order, tie_break=tie_break).where(f"_pos >= _n - {n}").drop("_pos", "_n")


def head(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: str = "ts", tie_break: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows by time of every series."""
    few = _edge(df, n, keys, order, tie_break, last=False)
    return with_positions(few, keys, order, tie_break=tie_break).where(f"_pos < {n}").drop("_pos", "_n")


def all_but_tail(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    return with_positions(df, keys, order).where(f"_pos < _n - {n}").drop("_pos", "_n")


def top_importance(df: DataFrame, n: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Top features with rank, a lag flag and an above-median flag.

    ``df`` has ``feature, feature_order, importance``: one row per feature, so
    every group is as small as the feature list.
    """
    ranked = Window.partitionBy(*keys).orderBy(F.col("importance").desc(), "feature_order")
    top = df.withColumn("rank", F.row_number().over(ranked)).where(f"rank <= {n}")
    return (
        top.withColumn("is_lag", F.contains("feature", F.lit("lag")))
        .withColumn("above_median", F.col("importance") > F.median("importance").over(Window.partitionBy(*keys)))
    )


def importance_share(df: DataFrame, n: int = 10, bar: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Top features with a bar length scaled to the largest importance."""
    ranked = Window.partitionBy(*keys).orderBy(F.col("importance").desc(), "feature_order")
    return (
        df.withColumn("rank", F.row_number().over(ranked))
        .withColumn("bar", F.floor(F.col("importance") / F.max("importance").over(Window.partitionBy(*keys)) * bar))
        .where(f"rank <= {n}")
    )

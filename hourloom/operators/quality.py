"""Data-quality rules reported in long form ``(series_id, rule, violations)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import KEY
from .buckets import hour_index, with_neighbours, with_positions


def _long(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str] = (KEY,)) -> DataFrame:
    wide = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in rules.items()])
    return wide.unpivot(list(keys), list(rules), "rule", "violations")


def range_report(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows outside ``[low, high]`` per column; ``None`` leaves a side open."""
    rules = {}
    for name, (low, high) in bounds.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(name) < low)
        if high is not None:
            bad = bad | (F.col(name) > high)
        rules[name] = F.count_if(bad)
    return _long(df, rules)


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _long(df, {c: F.count_if(F.col(c).isNull()) for c in columns})


def placeless_report(df: DataFrame, order: str = "ts") -> DataFrame:
    """Rows that positional operators leave out: without key, or without time.

    One row per series; rows without a key are counted under a null series.
    """
    return _long(df, {"no_key": F.count_if(F.col(KEY).isNull()), "no_time": F.count_if(F.col(order).isNull())})


def spacing_report(df: DataFrame) -> DataFrame:
    """Rows whose distance to the previous row is not exactly one hour."""
    rows = with_neighbours(df.select(KEY, "ts"), [], side="prev")
    step = hour_index("ts") - hour_index("_prev.ts")
    return rows.groupBy(KEY).agg(
        F.count("_prev").alias("n_steps"), F.count_if(step != 1).alias("violations")
    )


def interval_order_report(df: DataFrame, point="pred", lower="lower_gw", upper="upper_gw") -> DataFrame:
    both = F.col(lower).isNotNull() & F.col(upper).isNotNull()
    ordered = (F.col(lower) <= F.col(point)) & (F.col(point) <= F.col(upper))
    return df.groupBy(KEY).agg(F.count_if(both).alias("n_checked"), F.count_if(both & ~ordered).alias("violations"))


def lag_alignment_report(df: DataFrame, value="demand_gw", lag="demand_lag_1h", tolerance=1e-6) -> DataFrame:
    """Rows whose lag column differs from the previous row's value."""
    rows = with_neighbours(df.select(KEY, "ts", value, lag), [value], side="prev")
    off = F.abs(F.col(lag) - F.col(f"_prev.{value}")) >= tolerance
    return rows.groupBy(KEY).agg(F.count("_prev").alias("n_checked"), F.count_if(off).alias("violations"))


def ordering_report(df: DataFrame, temp="temperature_f", growth="data_center_load_gw") -> DataFrame:
    """Group means that must be ordered: January/July, 03:00/12:00, first/second half."""
    rows = with_positions(df.select(KEY, "ts", temp, growth))
    first_half = F.col("_pos") < F.floor(F.col("_n") / 2)
    mean = lambda value, cond: F.avg(F.when(cond, F.col(value)))
    return rows.groupBy(KEY).agg(
        mean(temp, F.month("ts") == 1).alias("january"),
        mean(temp, F.month("ts") == 7).alias("july"),
        mean(temp, F.hour("ts") == 3).alias("night"),
        mean(temp, F.hour("ts") == 12).alias("noon"),
        mean(growth, first_half).alias("first_half"),
        mean(growth, ~first_half).alias("second_half"),
    )


def schema_report(df: DataFrame, required: Sequence[str], expected_rows: int | None = None) -> DataFrame:
    """Missing required columns (known without a job) and a row-count check."""
    missing = [c for c in required if c not in df.columns]
    n = F.count("*")
    return df.agg(
        F.lit(",".join(missing)).alias("missing_columns"),
        n.alias("n_rows"),
        (n == expected_rows if expected_rows is not None else F.lit(True)).alias("rows_ok"),
    )


def warm_up_report(raw: DataFrame, features: DataFrame) -> DataFrame:
    """Rows lost to the lag warm-up per series; must be positive."""
    before = raw.groupBy(KEY).agg(F.count("*").alias("rows_in"))
    after = features.groupBy(KEY).agg(F.count("*").alias("rows_out"))
    return before.join(after, KEY, "left").select(
        KEY,
        "rows_in",
        F.coalesce("rows_out", F.lit(0)).alias("rows_out"),
        (F.coalesce("rows_out", F.lit(0)) < F.col("rows_in")).alias("shrunk"),
    )

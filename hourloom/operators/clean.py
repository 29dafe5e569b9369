"""Parsing, de-duplication, hourly grid, gap filling and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import KEY
from .buckets import KEYS, with_neighbours


def parse_period(period: Column) -> Column:
    """``2024-01-01T05`` to a timestamp, null when malformed."""
    return F.try_to_timestamp(period, F.lit("yyyy-MM-dd'T'HH"))


def parse_period_loose(period: Column) -> Column:
    """As ``parse_period``, also accepting a space separator, minutes and a ``+offset`` tail."""
    text = F.split_part(F.regexp_replace(period, "T", " "), F.lit("+"), F.lit(1))
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH")), F.try_to_timestamp(text))


def mega_to_giga(value: Column) -> Column:
    """MWh (number or text) to GW; anything that is not a number becomes null."""
    return value.try_cast("double") / 1000


def dedup_first(df: DataFrame, tie_break: str, keys: Sequence[str] = (KEY, "ts")) -> DataFrame:
    """Keep the row with the smallest ``tie_break`` per key.

    ``min`` of a struct combines before the shuffle, so a heavily repeated
    timestamp never gathers in one task.
    """
    return _pick(df, F.min, tie_break, keys)


def dedup_last(df: DataFrame, tie_break: str, keys: Sequence[str] = (KEY, "ts")) -> DataFrame:
    """Keep the row with the largest ``tie_break`` per key."""
    return _pick(df, F.max, tie_break, keys)


def _pick(df, choose, tie_break, keys):
    rest = [c for c in df.columns if c not in keys and c != tie_break]
    picked = df.groupBy(*keys).agg(choose(F.struct(tie_break, *rest)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def hourly_grid(df: DataFrame, value: str = "demand_gw") -> DataFrame:
    """Add the missing hours of each series, with a null value.

    Each observed row emits the hours up to its successor, so neither a grid
    table nor a join is needed.
    """
    return _spread(df, value).select(
        KEY, F.col("_hour").alias("ts"), F.when(F.col("_hour") == F.col("ts"), F.col(value)).alias(value)
    )


def _spread(df: DataFrame, value: str, step: str = "1 hour") -> DataFrame:
    rows = with_neighbours(df.select(KEY, "ts", value), [value], side="next")
    each = F.expr(f"interval {step}")
    until = F.coalesce(F.col("_next.ts") - each, F.col("ts"))
    return rows.withColumn("_hour", F.explode(F.sequence("ts", F.greatest(until, F.col("ts")), each)))


def _hours(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600


def _between(before: Column, after: Column, elapsed: Column, gap: Column) -> Column:
    return before + (after - before) * elapsed / gap


def gap_fill(df: DataFrame, value: str = "demand_gw", step: str = "1 hour") -> DataFrame:
    """Grid of ``step`` (hourly unless stated) and linear interpolation in one pass over non-null rows."""
    rows = _spread(df, value, step)
    filled = F.when(F.col("_hour") == F.col("ts"), F.col(value)).otherwise(
        _between(
            F.col(value),
            F.col(f"_next.{value}"),
            _hours(F.col("_hour"), F.col("ts")),
            _hours(F.col("_next.ts"), F.col("ts")),
        )
    )
    return rows.select(KEY, F.col("_hour").alias("ts"), filled.alias(value))


def interpolate_time(df: DataFrame, value: str = "demand_gw") -> DataFrame:
    """Fill null values linearly in time; trailing nulls repeat the last value."""
    rows = with_neighbours(df, [value], valid=value)
    between = _between(
        F.col(f"_prev.{value}"),
        F.col(f"_next.{value}"),
        _hours(F.col("ts"), F.col("_prev.ts")),
        _hours(F.col("_next.ts"), F.col("_prev.ts")),
    )
    carried = F.when(F.col("_next").isNull(), F.col(f"_prev.{value}"))
    return rows.withColumn(value, F.coalesce(value, between, carried)).drop("_prev", "_next")


def resample_daily_mean(df: DataFrame, value: str = "demand_gw") -> DataFrame:
    return df.groupBy(KEY, F.date_trunc("day", "ts").alias("ts")).agg(F.avg(value).alias(value))


def time_grid(df: DataFrame, start: str, end: str, step: str = "1 hour") -> DataFrame:
    """One row per step between two timestamp columns of ``df``."""
    return df.withColumn("ts", F.explode(F.sequence(start, end, F.expr(f"interval {step}")))).drop(start, end)

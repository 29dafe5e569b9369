"""Weather enrichment, calendar joins and unions with a preferred side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import HOLIDAYS
from ..functions.weather import synthetic_temperature
from ..session import KEY
from .clean import dedup_first, dedup_last

# A broadcast hint is given only to tables whose row count follows from code.
FIXED_ROWS = 10_000


def join_weather(demand: DataFrame, temperature: DataFrame) -> DataFrame:
    """Demand left-joined to one temperature per hour.

    The weather table has one row per hour of history. Its size is left to the
    statistics: Catalyst broadcasts it below the session's threshold and AQE
    splits skewed hours otherwise.
    """
    return demand.join(temperature.select("ts", "temperature_f"), "ts", "left")


def fill_temperature(df: DataFrame, decimals: int | None = 1) -> DataFrame:
    """Replace missing temperature by the seasonal proxy; add it when absent."""
    proxy = synthetic_temperature(F.col("ts"), decimals)
    if "temperature_f" not in df.columns:
        return df.withColumn("temperature_f", proxy)
    return df.withColumn("temperature_f", F.coalesce("temperature_f", proxy))


def join_weather_filled(demand: DataFrame, temperature: DataFrame | None, decimals: int | None = 1) -> DataFrame:
    if temperature is None:
        return fill_temperature(demand, decimals)
    return fill_temperature(join_weather(demand, temperature), decimals)


def join_by_date(hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """Hourly rows inner-joined to the daily row of their date and series."""
    return hourly.withColumn("date", F.to_date("ts")).join(
        daily.withColumn("date", F.to_date("ts")).drop("ts"), [KEY, "date"]
    )


def holiday_table(spark, profile: str) -> DataFrame:
    dates = HOLIDAYS[profile]
    assert len(dates) < FIXED_ROWS
    return spark.createDataFrame([(d,) for d in dates], "d string").select(F.col("d").cast("date").alias("holiday_date"))


def flag_holidays(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Existence join against a holiday table built by ``holiday_table``."""
    marks = F.broadcast(holidays.withColumn("_hit", F.lit(1)))
    return (
        df.join(marks, F.to_date("ts") == F.col("holiday_date"), "left")
        .withColumn("is_holiday", F.coalesce("_hit", F.lit(0)))
        .drop("holiday_date", "_hit")
    )


def union_ranked(*parts: DataFrame) -> DataFrame:
    """Union by name with ``src_rank`` = position of the source."""
    ranked = [p.withColumn("src_rank", F.lit(i)) for i, p in enumerate(parts)]
    out = ranked[0]
    for part in ranked[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def union_prefer_last(first: DataFrame, *later: DataFrame, keys=("ts",)) -> DataFrame:
    """Union where a later source replaces earlier rows of the same key."""
    return dedup_last(union_ranked(first, *later), "src_rank", keys).drop("src_rank")


def union_prefer_first(existing: DataFrame, *new: DataFrame, keys=(KEY, "ts")) -> DataFrame:
    """Union where stored rows win over new ones."""
    return dedup_first(union_ranked(existing, *new), "src_rank", keys).drop("src_rank")


def new_rows_only(existing: DataFrame, new: DataFrame, keys=(KEY, "ts")) -> DataFrame:
    """Insert-only merge: the new rows whose key is not stored yet."""
    return new.join(existing.select(*keys), list(keys), "left_anti")

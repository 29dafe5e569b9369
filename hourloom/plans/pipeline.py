"""From raw load rows to the canonical demand table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clean import dedup_first, gap_fill, mega_to_giga, parse_period
from ..operators.joins import fill_temperature, join_weather, join_weather_filled
from ..session import KEY


def clean_demand(raw: DataFrame, temperature: DataFrame | None = None) -> DataFrame:
    """``(series_id, period, value[, seq])`` to gap-free ``(series_id, ts, demand_gw, temperature_f)``.

    Of duplicate hours the row with the lowest ``seq`` (or value) stays.
    """
    typed = raw.select(
        KEY,
        parse_period(F.col("period")).alias("ts"),
        mega_to_giga(F.col("value")).alias("demand_gw"),
        (F.col("seq") if "seq" in raw.columns else mega_to_giga(F.col("value"))).alias("_seq"),
    ).where("ts is not null")
    unique = dedup_first(typed.dropna(subset=["demand_gw"]), "_seq").drop("_seq")
    return join_weather_filled(gap_fill(unique), temperature).select(KEY, "ts", "demand_gw", "temperature_f")


# Days that the weather archive lags behind, and days back that the forecast covers.
ARCHIVE_LAG_DAYS = 6
FORECAST_BACK_DAYS = 2


def known_weather(archive: DataFrame, forecast: DataFrame, now: Column) -> DataFrame:
    """Temperatures known at ``now``: the archive up to its lag, the forecast from its overlap on.

    Where both have an hour the archive wins. Hours in neither are left to the proxy.
    """
    old = archive.where(F.col("ts") <= now - F.make_dt_interval(days=F.lit(ARCHIVE_LAG_DAYS))).select("ts", "temperature_f")
    fresh = forecast.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(FORECAST_BACK_DAYS))).select("ts", "temperature_f")
    return old.unionByName(fresh.join(old.select("ts"), "ts", "left_anti"))


def weather_at(rows: DataFrame, archive: DataFrame, forecast: DataFrame, now: Column) -> DataFrame:
    """``rows`` with the temperature known at ``now``, else the unrounded proxy."""
    return fill_temperature(join_weather(rows, known_weather(archive, forecast, now)), decimals=None)

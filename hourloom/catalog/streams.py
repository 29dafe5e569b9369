"""Streaming forms, run to completion over the files of the data folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import KEY, scratch
from ..streaming import incremental as inc
from . import series as S
from .core import query
from .series import synthetic_sql

SERIES = "series_id ts:t demand_gw:f"


def _collect(spark, stream, mode, sink=inc.versioned_sink):
    path = scratch(spark, "stream-out")
    inc.run_available(stream, sink(path), mode)
    return path


@query("st_hourly_tumbling", SERIES, "SELECT * FROM hourly", "hourly")
def _(spark, sf):
    hours = inc.hourly_tumbling(inc.read_events(spark, sf))
    return inc.latest_versions(spark, _collect(spark, hours, "update"))


@query("st_dedup", "event_type n:i", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def _(spark, sf):
    rows = inc.read_events(spark, sf)
    repeated = rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    path = _collect(spark, inc.dedup(repeated, "event_id"), "append")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


def _two_files(rows, condition, path):
    """The rows as two files, those meeting the condition first: one batch each."""
    rows.where(condition).coalesce(1).write.parquet(path)
    rows.where(f"NOT ({condition})").coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("st_increment_merge", "series_id ts:t value:f", """
SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2""")
def _(spark, sf):
    """Two batches: hours that the first one stored keep their value."""
    path, state = scratch(spark, "merged"), scratch(spark, "merge-state")
    middle = S.events(spark, sf).agg(F.expr("percentile_approx(event_id, 0.5)")).head()[0]
    rows = _two_files(S.events(spark, sf), f"event_id <= {middle or 0}", scratch(spark, "event-files")).select(
        F.col("event_type").alias(KEY), F.date_trunc("hour", "ts").alias("ts"), "value", "event_id")
    # The second run finds its checkpoint and has nothing new to read.
    for _ in range(2):
        inc.run_available(rows, inc.merge_sink(path, tie_break="event_id"), "append", state)
    return spark.read.parquet(path)


@query("st_late_policy", "series_id ts:t demand_gw:f", """
SELECT series_id, ts, demand_gw FROM hourly
WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""", "hourly")
def _(spark, sf):
    """Append mode: hours still open under the reporting lag are held back."""
    hours = inc.hourly_tumbling(inc.read_events(spark, sf, watermark=inc.LATE_LOAD))
    return spark.read.parquet(_collect(spark, hours, "append"))


@query("st_lag_state", "series_id ts:t demand_gw:f lag_1:f lag_24:f lag_168:f", """
SELECT *, lag(demand_gw, 1) OVER o AS lag_1, lag(demand_gw, 24) OVER o AS lag_24, lag(demand_gw, 168) OVER o AS lag_168
FROM filled WINDOW o AS (PARTITION BY series_id ORDER BY ts)""", "filled")
def _(spark, sf):
    """Odd hours arrive in the second of two files: most lags are known late."""
    stream = _two_files(S.filled(spark, sf), "hour(ts) % 2 = 0", scratch(spark, "hourly-files"))
    values, out = scratch(spark, "lag-values"), scratch(spark, "lags")
    inc.run_available(stream, inc.lag_sink(values, out), "append")
    return inc.latest_versions(spark, out)


@query("st_weather_enrich", "event_id:i ts:t temperature_f:f", f"""
SELECT e.event_id, e.ts, coalesce(t.temperature_f, {synthetic_sql('e.ts', False)}) AS temperature_f
FROM (SELECT event_id, date_trunc('hour', ts) AS ts FROM events) e LEFT JOIN archive t ON e.ts = t.ts""", "archive")
def _(spark, sf):
    rows = inc.read_events(spark, sf).select("event_id", F.date_trunc("hour", "ts").alias("ts"))
    enriched = inc.enrich_weather(rows, S.temperature(spark, sf, "view"))
    return spark.read.parquet(_collect(spark, enriched, "append"))

"""Time-series cleaning, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import TRAIN_HOLIDAYS
from ..operators import clean, joins
from ..operators.buckets import time_bucket
from ..plans.pipeline import clean_demand, weather_at
from . import series as S
from .core import cte, query

SERIES = "series_id ts:t demand_gw:f"


def _typed(spark, sf):
    return S.raw_load(spark, sf).select(
        "series_id",
        clean.parse_period(F.col("period")).alias("ts"),
        clean.mega_to_giga(F.col("value")).alias("demand_gw"),
        "seq",
    )


cte("typed", """
SELECT series_id, try_strptime(period, '%Y-%m-%dT%H') AS ts,
       TRY_CAST(value AS DOUBLE) / 1000 AS demand_gw, seq FROM raw_load""", "raw_load")
cte("unique_first", """
SELECT series_id, ts, demand_gw FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY seq) AS rn
  FROM typed WHERE demand_gw IS NOT NULL) WHERE rn = 1""", "typed")


@query("ts_dedup_first", SERIES, "SELECT * FROM unique_first", "unique_first")
def _(spark, sf):
    return clean.dedup_first(_typed(spark, sf).dropna(subset=["demand_gw"]), "seq")


@query("ts_dedup_last", SERIES, """
SELECT series_id, ts, arg_max(demand_gw, seq) AS demand_gw
FROM typed WHERE demand_gw IS NOT NULL GROUP BY 1, 2""", "typed")
def _(spark, sf):
    return clean.dedup_last(_typed(spark, sf).dropna(subset=["demand_gw"]), "seq")


cte("grid", """
SELECT g.series_id, g.ts, h.demand_gw
FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
      FROM hourly GROUP BY series_id) g
LEFT JOIN hourly h ON g.series_id = h.series_id AND g.ts = h.ts""", "hourly")


@query("ts_hourly_grid", SERIES, "SELECT * FROM grid", "grid")
def _(spark, sf):
    return clean.hourly_grid(S.hourly(spark, sf))


@query("ts_interpolate_time", SERIES, "SELECT * FROM filled", "filled")
def _(spark, sf):
    return clean.interpolate_time(clean.hourly_grid(S.hourly(spark, sf)))


@query("ts_interpolate_by_user", SERIES, "SELECT * FROM filled_user", "filled_user")
def _(spark, sf):
    return clean.gap_fill(S.by_user(spark, sf))


@query("ts_resample_daily_mean", SERIES, """
SELECT series_id, date_trunc('day', ts) AS ts, avg(demand_gw) AS demand_gw FROM grid GROUP BY 1, 2""", "grid")
def _(spark, sf):
    return clean.resample_daily_mean(clean.hourly_grid(S.hourly(spark, sf)))


cte("clean_base", S._filled_sql("unique_first"), "unique_first")


@query("ts_clean_pipeline", SERIES + " temperature_f:f", f"""
SELECT d.series_id, d.ts, d.demand_gw, coalesce(t.temperature_f, {S.synthetic_sql('d.ts')}) AS temperature_f
FROM clean_base d LEFT JOIN archive t ON d.ts = t.ts""", "clean_base archive")
def _(spark, sf):
    return clean_demand(S.raw_load(spark, sf), S.temperature(spark, sf, "view"))


# Joins


@query("join_weather_left", SERIES + " temperature_f:f", """
SELECT d.*, t.temperature_f FROM filled d LEFT JOIN archive t ON d.ts = t.ts""", "filled archive")
def _(spark, sf):
    return joins.join_weather(S.filled(spark, sf), S.temperature(spark, sf, "view"))


@query("join_proxy_fill", SERIES + " temperature_f:f serve_temperature_f:f", f"""
SELECT d.*, coalesce(t.temperature_f, {S.synthetic_sql('d.ts')}) AS temperature_f,
       coalesce(t.temperature_f, {S.synthetic_sql('d.ts', False)}) AS serve_temperature_f
FROM filled d LEFT JOIN archive t ON d.ts = t.ts""", "filled archive")
def _(spark, sf):
    joined = joins.join_weather(S.filled(spark, sf), S.temperature(spark, sf, "view"))
    serving = joins.fill_temperature(joined, decimals=None).withColumnRenamed("temperature_f", "serve_temperature_f")
    return joins.join_weather_filled(serving, S.temperature(spark, sf, "view"))


@query("join_date_inner", "series_id ts:t hourly_gw:f daily_gw:f", """
SELECT h.series_id, h.ts, h.demand_gw AS hourly_gw, d.demand_gw AS daily_gw
FROM filled h JOIN (SELECT series_id, date_trunc('day', ts) AS ts, avg(demand_gw) AS demand_gw
                    FROM filled GROUP BY 1, 2) d
  ON h.series_id = d.series_id AND date_trunc('day', h.ts) = d.ts""", "filled")
def _(spark, sf):
    demand = S.filled(spark, sf)
    daily = clean.resample_daily_mean(demand).withColumnRenamed("demand_gw", "daily_gw")
    return joins.join_by_date(demand.withColumnRenamed("demand_gw", "hourly_gw"), daily)


_holiday_list = ", ".join(f"DATE '{d}'" for d in TRAIN_HOLIDAYS)


@query("join_holiday_member", SERIES + " is_holiday:i", f"""
SELECT *, CASE WHEN CAST(ts AS DATE) IN ({_holiday_list}) THEN 1 ELSE 0 END AS is_holiday FROM filled""", "filled")
def _(spark, sf):
    return joins.flag_holidays(S.filled(spark, sf), joins.holiday_table(spark, "train"))


# Set operations


@query("set_union_prefer_last", "ts:t temperature_f:f", """
SELECT coalesce(f.ts, a.ts) AS ts, coalesce(f.temperature_f, a.temperature_f) AS temperature_f
FROM archive a FULL JOIN forecast f ON a.ts = f.ts""", "archive forecast")
def _(spark, sf):
    return joins.union_prefer_last(S.temperature(spark, sf, "view"), S.temperature(spark, sf, "click"))


cte("old_part", """
SELECT series_id, ts, demand_gw FROM hourly WHERE ts < TIMESTAMP '2024-01-20'""", "hourly")
cte("new_part", """
SELECT series_id, ts, demand_gw * 2 AS demand_gw FROM hourly WHERE ts >= TIMESTAMP '2024-01-15'""", "hourly")


def _old_new(spark, sf):
    rows = S.hourly(spark, sf)
    old = rows.where("ts < timestamp'2024-01-20'")
    new = rows.where("ts >= timestamp'2024-01-15'").withColumn("demand_gw", F.col("demand_gw") * 2)
    return old, new


@query("set_union_prefer_first", SERIES, """
SELECT * FROM old_part UNION ALL
SELECT n.* FROM new_part n ANTI JOIN old_part o ON n.series_id = o.series_id AND n.ts = o.ts""", "old_part new_part")
def _(spark, sf):
    return joins.union_prefer_first(*_old_new(spark, sf))


@query("set_append_points", SERIES + " origin", """
SELECT *, 'history' AS origin FROM old_part UNION ALL
SELECT *, 'produced' AS origin FROM new_part WHERE ts >= TIMESTAMP '2024-01-20'""", "old_part new_part")
def _(spark, sf):
    old, new = _old_new(spark, sf)
    return old.withColumn("origin", F.lit("history")).unionByName(
        joins.new_rows_only(old, new).where("ts >= timestamp'2024-01-20'").withColumn("origin", F.lit("produced"))
    )


@query("join_weather_policy", "series_id ts:t demand_gw:f temperature_f:f", f"""
SELECT f.series_id, f.ts, f.demand_gw, coalesce(a.temperature_f, c.temperature_f, {S.synthetic_sql("f.ts", False)}) AS temperature_f
FROM filled f
LEFT JOIN archive a ON a.ts = f.ts AND a.ts <= TIMESTAMP '2024-01-20' - INTERVAL 6 DAY
LEFT JOIN forecast c ON c.ts = f.ts AND c.ts >= TIMESTAMP '2024-01-20' - INTERVAL 2 DAY""", "filled archive forecast")
def _(spark, sf):
    """Temperatures known on one day: late archive, overlapping forecast, proxy in between."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return weather_at(S.filled(spark, sf), S.temperature(spark, sf, "view"), S.temperature(spark, sf, "click"), now)

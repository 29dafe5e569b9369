"""Series derived from the driver tables, on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weather import synthetic_temperature
from ..operators.clean import gap_fill
from .core import cte


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """One series per event type: the hourly sum of values."""
    return (
        events(spark, sf)
        .groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.round(F.sum("value"), 6).alias("demand_gw"))
    )


cte("hourly", """
SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 6) AS demand_gw
FROM events GROUP BY 1, 2""")


def by_user(spark: SparkSession, sf: str) -> DataFrame:
    """One series per user: their number grows with the data."""
    return (
        events(spark, sf)
        .groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("series_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.round(F.sum("value"), 6).alias("demand_gw"))
    )


cte("by_user", """
SELECT 'u' || user_id AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 6) AS demand_gw
FROM events GROUP BY 1, 2""")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """One series per order priority: the daily sum of prices in thousands."""
    return (
        spark.read.parquet(f"{sf}/orders.parquet")
        .groupBy(
            F.col("o_orderpriority").alias("series_id"),
            F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts"),
        )
        .agg(F.round(F.sum("o_totalprice") / 1000, 5).alias("demand_gw"))
    )


cte("daily", """
SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts,
       round(sum(o_totalprice) / 1000, 5) AS demand_gw
FROM orders GROUP BY 1, 2""")


def filled(spark: SparkSession, sf: str) -> DataFrame:
    return gap_fill(hourly(spark, sf))


def _filled_sql(source: str) -> str:
    return f"""
SELECT series_id, ts,
       CASE WHEN v IS NOT NULL THEN v
            ELSE pv + (nv - pv) * CAST(date_diff('hour', pt, ts) AS DOUBLE)
                 / CAST(date_diff('hour', pt, nt) AS DOUBLE) END AS demand_gw
FROM (
  SELECT g.series_id, g.ts, h.demand_gw AS v,
    last_value(h.demand_gw IGNORE NULLS) OVER back AS pv,
    last_value(h.ts IGNORE NULLS) OVER back AS pt,
    first_value(h.demand_gw IGNORE NULLS) OVER ahead AS nv,
    first_value(h.ts IGNORE NULLS) OVER ahead AS nt
  FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
        FROM {source} GROUP BY series_id) g
  LEFT JOIN {source} h ON g.series_id = h.series_id AND g.ts = h.ts
  WINDOW back AS (PARTITION BY g.series_id ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY g.series_id ORDER BY g.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)"""


cte("filled", _filled_sql("hourly"), "hourly")
cte("filled_user", _filled_sql("by_user"), "by_user")


def synthetic_sql(ts: str = "ts", rounded: bool = True) -> str:
    raw = (f"55.0 + cos((dayofyear({ts}) - 15) * (2 * pi()) / 365) * -22"
           f" + sin((hour({ts}) - 6) * (2 * pi()) / 24) * 6")
    return f"(round_even(({raw}) * 10.0, 0) / 10.0)" if rounded else f"({raw})"


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Gap-free demand with the seasonal temperature proxy."""
    return filled(spark, sf).withColumn("temperature_f", synthetic_temperature(F.col("ts")))


cte("canonical", f"SELECT series_id, ts, demand_gw, {synthetic_sql()} AS temperature_f FROM filled", "filled")
cte("canonical_user",
    f"SELECT series_id, ts, demand_gw, {synthetic_sql()} AS temperature_f FROM filled_user", "filled_user")


def raw_load(spark: SparkSession, sf: str) -> DataFrame:
    """Unparsed rows with repeated hours and values that are not numbers."""
    mwh = F.round(F.col("value") * 1000).cast("bigint").cast("string")
    return events(spark, sf).select(
        F.col("event_type").alias("series_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH").alias("period"),
        F.when(F.col("value") > 200, F.lit("n/a")).otherwise(mwh).alias("value"),
        F.col("event_id").alias("seq"),
    )


cte("raw_load", """
SELECT event_type AS series_id, strftime(ts, '%Y-%m-%dT%H') AS period,
       CASE WHEN value > 200 THEN 'n/a' ELSE CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR) END AS value,
       event_id AS seq
FROM events""")


def temperature(spark: SparkSession, sf: str, source: str) -> DataFrame:
    """Hourly mean value of one event type, standing in for a weather feed."""
    return (
        events(spark, sf)
        .where(F.col("event_type") == source)
        .groupBy(F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.round(F.avg("value"), 6).alias("temperature_f"))
    )


for _name, _type in (("archive", "view"), ("forecast", "click")):
    cte(_name, f"""
SELECT date_trunc('hour', ts) AS ts, round(avg(value), 6) AS temperature_f
FROM events WHERE event_type = '{_type}' GROUP BY 1""")


NAIVE = {"naive_day": 24, "naive_week": 168}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long predictions of two deterministic models, yesterday and last week."""
    return naive_predictions(filled(spark, sf))


def naive_predictions(demand: DataFrame) -> DataFrame:
    from ..operators.buckets import drop_halo, halo_window, with_halo

    w = halo_window()
    rows = drop_halo(
        with_halo(demand, 168).withColumns({m: F.lag("demand_gw", k).over(w) for m, k in NAIVE.items()})
    )
    return rows.unpivot(
        ["series_id", "ts", F.col("demand_gw").alias("actual")], list(NAIVE), "model", "pred"
    ).where("pred is not null")


cte("predictions", """
SELECT * FROM (
  SELECT series_id, ts, demand_gw AS actual, 'naive_day' AS model,
         lag(demand_gw, 24) OVER (PARTITION BY series_id ORDER BY ts) AS pred FROM filled
  UNION ALL
  SELECT series_id, ts, demand_gw, 'naive_week',
         lag(demand_gw, 168) OVER (PARTITION BY series_id ORDER BY ts) FROM filled
) WHERE pred IS NOT NULL""", "filled")

"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..operators.joins import join_weather
from ..plans import features as feats
from ..plans.intervals import const_band
from . import series as S
from .core import cte, query
from .windows import features_sql

LONG = "series_id rule violations:i"
cte("features", features_sql("canonical"), "canonical")
cte("joined", "SELECT d.*, t.temperature_f FROM filled d LEFT JOIN archive t ON d.ts = t.ts", "filled", "archive")

RANGES = {
    "demand_gw": (40.0, 200.0), "temperature_f": (-20.0, 115.0), "hour_sin": (-1.0001, 1.0001),
    "dow_cos": (-1.0001, 1.0001), "temp_cooling": (0.0, None), "temp_heating": (0.0, None), "is_weekend": (0.0, 1.0),
}


def _features(spark, sf):
    return feats.build_features(S.canonical(spark, sf))


def _range_sql() -> str:
    parts = []
    for name, (low, high) in RANGES.items():
        bad = " OR ".join(x for x in (f"{name} < {low}", f"{name} > {high}" if high is not None else "") if x)
        parts.append(f"SELECT series_id, '{name}' AS rule, count(*) FILTER ({bad}) AS violations FROM features GROUP BY 1")
    return " UNION ALL ".join(parts)


@query("dq_range", LONG, _range_sql(), "features")
def _(spark, sf):
    return quality.range_report(_features(spark, sf), RANGES)


@query("dq_hourly_spacing", "series_id n_steps:i violations:i", """
SELECT series_id, count(p) AS n_steps, count(*) FILTER (date_diff('hour', p, ts) <> 1) AS violations
FROM (SELECT series_id, ts, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM hourly) GROUP BY 1""", "hourly")
def _(spark, sf):
    return quality.spacing_report(S.hourly(spark, sf))


@query("dq_interval_order", "series_id n_checked:i violations:i", """
SELECT series_id, count(*) AS n_checked,
       count(*) FILTER (NOT (pred - 0.62 <= actual AND actual <= pred + 0.61)) AS violations
FROM predictions GROUP BY 1""", "predictions")
def _(spark, sf):
    return quality.interval_order_report(const_band(S.predictions(spark, sf)), point="actual")


@query("dq_null_counts", LONG, """
SELECT series_id, 'demand_gw' AS rule, count(*) - count(demand_gw) AS violations FROM joined GROUP BY 1 UNION ALL
SELECT series_id, 'temperature_f', count(*) - count(temperature_f) FROM joined GROUP BY 1""", "joined")
def _(spark, sf):
    joined = join_weather(S.filled(spark, sf), S.temperature(spark, sf, "view"))
    return quality.null_report(joined, ["demand_gw", "temperature_f"])


cte("placed", """
SELECT nullif(event_type, 'click') AS k, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS t FROM events""")


@query("dq_placeless", LONG, """
SELECT k AS series_id, 'no_key' AS rule, count(*) FILTER (k IS NULL) AS violations FROM placed GROUP BY 1 UNION ALL
SELECT k, 'no_time', count(*) FILTER (t IS NULL) FROM placed GROUP BY 1""", "placed")
def _(spark, sf):
    rows = S.events(spark, sf).select(F.expr("nullif(event_type, 'click')").alias("series_id"), F.expr("if(event_id % 7 = 0, null, ts)").alias("ts"))
    return quality.placeless_report(rows)


@query("dq_schema_rows", "missing_columns n_rows:i rows_ok", """
SELECT 'absent' AS missing_columns, count(*) AS n_rows, TRUE AS rows_ok FROM features""", "features")
def _(spark, sf):
    return quality.schema_report(_features(spark, sf), [*feats.feature_names(), "absent"])


@query("dq_warm_up", "series_id rows_in:i rows_out:i shrunk", """
SELECT c.series_id, c.n AS rows_in, coalesce(f.n, 0) AS rows_out, coalesce(f.n, 0) < c.n AS shrunk
FROM (SELECT series_id, count(*) AS n FROM canonical GROUP BY 1) c
LEFT JOIN (SELECT series_id, count(*) AS n FROM features GROUP BY 1) f ON c.series_id = f.series_id""", "canonical features")
def _(spark, sf):
    return quality.warm_up_report(S.canonical(spark, sf), _features(spark, sf))


@query("dq_lag_alignment", "series_id n_checked:i violations:i", """
SELECT series_id, count(p) AS n_checked, count(*) FILTER (abs(demand_lag_1h - p) >= 1e-6) AS violations
FROM (SELECT *, lag(demand_gw) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM features) GROUP BY 1""", "features")
def _(spark, sf):
    return quality.lag_alignment_report(_features(spark, sf))


@query("dq_ordering", "series_id january:f july:f night:f noon:f first_half:f second_half:f", """
SELECT series_id, avg(temperature_f) FILTER (month(ts) = 1) AS january, avg(temperature_f) FILTER (month(ts) = 7) AS july,
  avg(temperature_f) FILTER (hour(ts) = 3) AS night, avg(temperature_f) FILTER (hour(ts) = 12) AS noon,
  avg(data_center_load_gw) FILTER (pos < n // 2) AS first_half, avg(data_center_load_gw) FILTER (pos >= n // 2) AS second_half
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos,
             count(*) OVER (PARTITION BY series_id) AS n FROM features) GROUP BY 1""", "features")
def _(spark, sf):
    return quality.ordering_report(_features(spark, sf))

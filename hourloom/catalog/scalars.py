"""Projections, filters and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import calendar, demand, stats, weather
from ..functions.calendar import BACKTEST_HOLIDAYS, SERVE_HOLIDAYS, TRAIN_HOLIDAYS
from ..operators import clean, split
from ..plans import features as feats
from . import series as S
from .core import cte, query

# Projections and filters


@query("prj_unit_convert", "series_id seq:i gw:f", """
SELECT series_id, seq, TRY_CAST(value AS DOUBLE) / 1000 AS gw FROM raw_load""", "raw_load")
def _(spark, sf):
    return S.raw_load(spark, sf).withColumn("gw", clean.mega_to_giga(F.col("value")))


@query("prj_parse_period", "seq:i strict:t loose:t bad:t", """
SELECT seq, try_strptime(period, '%Y-%m-%dT%H') AS strict, try_strptime(period, '%Y-%m-%dT%H') AS loose,
       try_strptime(value, '%Y-%m-%dT%H') AS bad FROM raw_load""", "raw_load")
def _(spark, sf):
    return S.raw_load(spark, sf).select(
        "seq",
        clean.parse_period(F.col("period")).alias("strict"),
        clean.parse_period_loose(F.concat("period", F.lit(":00+00:00"))).alias("loose"),
        clean.parse_period(F.col("value")).alias("bad"),
    )


@query("flt_null_drop_key", "series_id seq:i gw:f", """
SELECT series_id, seq, TRY_CAST(value AS DOUBLE) / 1000 AS gw FROM raw_load
WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL""", "raw_load")
def _(spark, sf):
    return S.raw_load(spark, sf).withColumn("gw", clean.mega_to_giga(F.col("value"))).dropna(subset=["gw"])


LAGGED = """
SELECT series_id, ts, demand_gw,
       lag(demand_gw, 24) OVER (PARTITION BY series_id ORDER BY ts) AS demand_lag_24h,
       lag(demand_gw, 168) OVER (PARTITION BY series_id ORDER BY ts) AS demand_lag_168h
FROM filled"""
cte("lagged", LAGGED, "filled")


def _lagged(spark, sf):
    from ..operators.buckets import drop_halo, halo_window, with_halo

    w = halo_window()
    return drop_halo(with_halo(S.filled(spark, sf), 168).withColumns(
        feats.lag_columns("demand_gw", [24, 168], w)))


LAG_SPEC = "series_id ts:t demand_gw:f demand_lag_24h:f demand_lag_168h:f"


@query("flt_null_drop_any", LAG_SPEC, """
SELECT * FROM lagged WHERE demand_lag_24h IS NOT NULL AND demand_lag_168h IS NOT NULL""", "lagged")
def _(spark, sf):
    return _lagged(spark, sf).dropna()


@query("prj_fillna_zero", LAG_SPEC, """
SELECT series_id, ts, demand_gw, coalesce(demand_lag_24h, 0) AS demand_lag_24h,
       coalesce(demand_lag_168h, 0) AS demand_lag_168h FROM lagged""", "lagged")
def _(spark, sf):
    return split.fill_features(_lagged(spark, sf), ["demand_lag_24h", "demand_lag_168h"])


@query("prj_feature_select", "demand_lag_24h:f demand_lag_168h:f", """
SELECT demand_lag_24h, demand_lag_168h FROM lagged""", "lagged")
def _(spark, sf):
    rows = _lagged(spark, sf).withColumn("temperature_f", F.lit(0.0))
    return rows.select(*split.feature_columns(rows))


CUT = "2024-01-20"


@query("flt_temporal_split", "series_id ts:t demand_gw:f split", f"""
SELECT *, CASE WHEN ts < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS split FROM filled""", "filled")
def _(spark, sf):
    train, test = split.temporal_split(S.filled(spark, sf), CUT)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("flt_calibration_split", "series_id ts:t demand_gw:f split", f"""
SELECT series_id, ts, demand_gw,
       CASE WHEN ts >= TIMESTAMP '{CUT}' THEN 'test'
            WHEN row_number() OVER (PARTITION BY series_id, ts < TIMESTAMP '{CUT}' ORDER BY ts DESC) <= 120
            THEN 'calibration' ELSE 'train' END AS split
FROM filled""", "filled")
def _(spark, sf):
    return split.label_splits(S.filled(spark, sf), CUT, calibration=120)


@query("prj_temp_col_resolve", "series_id ts:t temp_sq:f temp_cooling:f temp_heating:f none_sq:f", f"""
SELECT series_id, ts, t * t AS temp_sq, greatest(0.0, t - 65) AS temp_cooling,
       greatest(0.0, 45 - t) AS temp_heating, 0.0 AS none_sq
FROM (SELECT series_id, ts, {S.synthetic_sql()} AS t FROM filled)""", "filled")
def _(spark, sf):
    base = S.filled(spark, sf)
    renamed = base.withColumn("temp_f", weather.synthetic_temperature(F.col("ts")))
    return renamed.withColumns(feats._temperature_features(renamed, "full")).withColumn(
        "none_sq", feats._temperature_features(base, "full")["temp_sq"]
    )


# Scalar functions over the hours of the orders: six and a half years of dates


def _order_hours(spark, sf):
    """Order dates moved to an hour of day taken from the order key."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    hours = F.make_dt_interval(hours=F.pmod("o_orderkey", F.lit(24)).cast("int"))
    # Shifted by 27 years so that the holiday lists are met.
    years = F.make_ym_interval(F.lit(25), F.lit(0))
    return rows.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderdate").cast("timestamp") + years + hours).alias("ts"),
        F.col("o_totalprice").alias("price"),
    )


cte("order_hours", """
SELECT o_orderkey AS id, o_orderdate + INTERVAL 25 YEAR + to_hours(o_orderkey % 24) AS ts,
       o_totalprice AS price FROM orders""")


@query("fn_calendar", "id:i hour:i dayofweek:i month:i dayofyear:i weekofyear:i quarter:i", """
SELECT id, hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, month(ts) AS month, dayofyear(ts) AS dayofyear,
       week(ts) AS weekofyear, quarter(ts) AS quarter FROM order_hours""", "order_hours")
def _(spark, sf):
    rows = _order_hours(spark, sf)
    return rows.withColumns(calendar.calendar_columns(F.col("ts")))


@query("fn_weekend", "id:i is_weekend:i", """
SELECT id, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM order_hours""", "order_hours")
def _(spark, sf):
    return _order_hours(spark, sf).withColumn("is_weekend", calendar.is_weekend(F.col("ts")))


def _in_dates(dates) -> str:
    listed = ", ".join(f"DATE '{d}'" for d in dates)
    return f"CASE WHEN CAST(ts AS DATE) IN ({listed}) THEN 1 ELSE 0 END"


FIXED_SQL = ("CASE WHEN (month(ts) * 100 + day(ts)) IN (101, 704, 1111, 1225, 1231) THEN 1 ELSE 0 END")


@query("fn_holiday", "id:i train:i backtest:i serve:i fixed:i", f"""
SELECT id, {_in_dates(TRAIN_HOLIDAYS)} AS train, {_in_dates(BACKTEST_HOLIDAYS)} AS backtest,
       {_in_dates(SERVE_HOLIDAYS)} AS serve, {FIXED_SQL} AS fixed FROM order_hours""", "order_hours")
def _(spark, sf):
    profiles = ("train", "backtest", "serve", "fixed")
    return _order_hours(spark, sf).withColumns({p: calendar.is_holiday(F.col("ts"), p) for p in profiles})


def cyclic_sql(ts: str = "ts") -> str:
    parts = {"hour": f"hour({ts})", "dow": f"(isodow({ts}) - 1)", "month": f"month({ts})", "dayofyear": f"dayofyear({ts})"}
    cols = []
    for name, expr in parts.items():
        angle = f"{expr} * (2 * pi()) / {calendar.CYCLES[name]}"
        cols += [f"sin({angle}) AS {name}_sin", f"cos({angle}) AS {name}_cos"]
    return ", ".join(cols)


CYCLIC_SPEC = " ".join(f"{c}_{f}:f" for c in calendar.CYCLES for f in ("sin", "cos"))


@query("fn_cyclic", f"id:i {CYCLIC_SPEC}", f"SELECT id, {cyclic_sql()} FROM order_hours", "order_hours")
def _(spark, sf):
    return _order_hours(spark, sf).withColumns(calendar.cyclic_columns(F.col("ts")))


@query("fn_degree", "ts:t demand_gw:f temperature_f:f temp_sq:f temp_cooling:f temp_heating:f", """
SELECT d.ts, d.demand_gw, t.temperature_f, t.temperature_f * t.temperature_f AS temp_sq,
       CASE WHEN t.temperature_f IS NOT NULL THEN greatest(0.0, t.temperature_f - 65) END AS temp_cooling,
       CASE WHEN t.temperature_f IS NOT NULL THEN greatest(0.0, 45 - t.temperature_f) END AS temp_heating
FROM filled d LEFT JOIN archive t ON d.ts = t.ts""", "filled archive")
def _(spark, sf):
    from ..operators.joins import join_weather

    joined = join_weather(S.filled(spark, sf), S.temperature(spark, sf, "view"))
    return joined.withColumns(weather.degree_columns(F.col("temperature_f")))


GROWTH_SQL = "2.0 + date_diff('day', DATE '2022-01-01', CAST(ts AS DATE)) / 365.0 * 0.75"


@query("fn_growth_proxy", "id:i growth:f", f"SELECT id, {GROWTH_SQL} AS growth FROM order_hours", "order_hours")
def _(spark, sf):
    return _order_hours(spark, sf).withColumn("growth", calendar.growth_proxy(F.col("ts")))


@query("fn_synthetic_temp", "id:i rounded:f unrounded:f", f"""
SELECT id, {S.synthetic_sql()} AS rounded, {S.synthetic_sql(rounded=False)} AS unrounded
FROM order_hours""", "order_hours")
def _(spark, sf):
    return _order_hours(spark, sf).select(
        "id",
        weather.synthetic_temperature(F.col("ts")).alias("rounded"),
        weather.synthetic_temperature(F.col("ts"), None).alias("unrounded"),
    )


HVAC_SQL = "greatest(0.0, {t} - 65) * 0.18 + greatest(0.0, 45 - {t}) * 0.12"


@query("fn_hvac_load", "id:i hvac:f", f"""
SELECT id, {HVAC_SQL.format(t='t')} AS hvac
FROM (SELECT id, {S.synthetic_sql(rounded=False)} AS t FROM order_hours)""", "order_hours")
def _(spark, sf):
    temp = weather.synthetic_temperature(F.col("ts"), None)
    return _order_hours(spark, sf).withColumn("hvac", weather.hvac_load(temp))


CURVE_SQL = """CASE WHEN hour(ts) < 6 THEN 0.55::DOUBLE WHEN hour(ts) < 9 THEN 0.55 + (hour(ts) - 6) / 3.0::DOUBLE * 0.30
WHEN hour(ts) < 17 THEN 0.85 WHEN hour(ts) < 21 THEN 0.85 + (hour(ts) - 17) / 4.0::DOUBLE * 0.15
ELSE 1.0 - (hour(ts) - 21) / 3.0::DOUBLE * 0.45 END"""


@query("fn_daily_curve", "id:i curve:f", f"SELECT id, {CURVE_SQL} AS curve FROM order_hours", "order_hours")
def _(spark, sf):
    return _order_hours(spark, sf).withColumn("curve", demand.daily_curve(F.hour("ts")))


STRUCTURAL_SQL = f"""greatest(10.0, (25.0 + 3.75 * (pow(1.08, epoch(ts - TIMESTAMP '2022-01-01') / (365.25 * 24 * 3600)) - 1)
  + 18.0 * ({CURVE_SQL}) + {HVAC_SQL.format(t=S.synthetic_sql(rounded=False))})
  * CASE WHEN isodow(ts) >= 6 THEN 0.85 ELSE 1.0 END * CASE WHEN {FIXED_SQL} = 1 THEN 0.78 ELSE 1.0 END)"""


@query("fn_structural_load", "id:i load_gw:f", f"SELECT id, {STRUCTURAL_SQL} AS load_gw FROM order_hours", "order_hours")
def _(spark, sf):
    ts = F.col("ts")
    start = F.lit("2022-01-01").cast("timestamp")
    temp = weather.synthetic_temperature(ts, None)
    return _order_hours(spark, sf).withColumn("load_gw", demand.structural_load(ts, start, temp))


@query("fn_round", "id:i one:f three:f half:f", """
SELECT id, round_even(price * 10.0, 0) / 10.0 AS one, round_even(price / 8 * 1000.0, 0) / 1000.0 AS three,
       round_even(id / 2.0, 0) AS half
FROM order_hours""", "order_hours")
def _(spark, sf):
    return _order_hours(spark, sf).select(
        "id",
        stats.half_even(F.col("price"), 1).alias("one"),
        stats.half_even(F.col("price") / 8, 3).alias("three"),
        stats.half_even(F.col("id") / 2, 0).alias("half"),
    )


@query("fn_iso_format", "id:i iso date_text hour_key", """
SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d') AS date_text,
       strftime(ts, '%Y-%m-%dT%H') AS hour_key FROM order_hours""", "order_hours")
def _(spark, sf):
    return _order_hours(spark, sf).select(
        "id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_text"),
        F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour_key"),
    )


@query("fn_nonconformity", "series_id ts:t score:f", """
SELECT d.series_id, d.ts, greatest(least(d.pred, w.pred) - d.actual, d.actual - greatest(d.pred, w.pred)) AS score
FROM predictions d JOIN predictions w ON d.series_id = w.series_id AND d.ts = w.ts
WHERE d.model = 'naive_day' AND w.model = 'naive_week'""", "predictions")
def _(spark, sf):
    from ..plans.intervals import nonconformity

    rows = _lagged(spark, sf).dropna()
    low = F.least("demand_lag_24h", "demand_lag_168h")
    high = F.greatest("demand_lag_24h", "demand_lag_168h")
    return rows.withColumn("score", nonconformity(F.col("demand_gw"), low, high))


def _horner_sql(x: str, coefs) -> str:
    acc = f"{coefs[0]!r}::DOUBLE"
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {c!r}::DOUBLE)"
    return acc


def two_sided_p_sql(z: str) -> str:
    x = f"(abs({z}) / {math.sqrt(2.0)!r})"
    t = f"(1.0::DOUBLE / (1.0 + {stats.ERF_P!r} * {x}))"
    return f"({_horner_sql(t, stats.ERF_A[::-1])} * {t} * exp(-{x} * {x}))"


def ppf_sql(p: str) -> str:
    tail = lambda q: f"{_horner_sql(q, stats.PPF_C)} / {_horner_sql(q, stats.PPF_D + (1.0,))}"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1.0 - {p}))"
    mid = f"({p} - 0.5)"
    sq = f"({mid} * {mid})"
    return (f"CASE WHEN {p} < {stats.PPF_LOW} THEN {tail(low)} WHEN {p} > {1 - stats.PPF_LOW} THEN -({tail(high)}) "
            f"ELSE {_horner_sql(sq, stats.PPF_A)} * {mid} / {_horner_sql(sq, stats.PPF_B + (1.0,))} END")


cte("z_scores", """
SELECT event_id, (value - 50.0) / 50.0 AS z, (1.0 + value) / (2.0 + value + abs(value - 50.0)) AS p FROM events""")


def _z(spark, sf):
    v = F.col("value")
    return S.events(spark, sf).select(
        "event_id", ((v - 50.0) / 50.0).alias("z"), ((v + 1.0) / (v + 2.0 + F.abs(v - 50.0))).alias("p")
    )


@query("fn_normal_cdf", "event_id:i cdf:f", f"""
SELECT event_id, CASE WHEN z >= 0 THEN 1.0 - {two_sided_p_sql('z')} / 2 ELSE {two_sided_p_sql('z')} / 2 END AS cdf
FROM z_scores""", "z_scores")
def _(spark, sf):
    return _z(spark, sf).withColumn("cdf", stats.normal_cdf(F.col("z")))


@query("fn_normal_ppf", "event_id:i ppf:f", f"SELECT event_id, {ppf_sql('p')} AS ppf FROM z_scores", "z_scores")
def _(spark, sf):
    return _z(spark, sf).withColumn("ppf", stats.normal_ppf(F.col("p")))

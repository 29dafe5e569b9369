"""Window features, positional slices and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank
from ..operators.buckets import drop_halo, halo_window, with_halo, with_positions
from ..plans import features as feats
from . import series as S
from .core import cte, query
from .scalars import CYCLIC_SPEC, GROWTH_SQL, _in_dates, cyclic_sql
from ..functions.calendar import BACKTEST_HOLIDAYS, SERVE_HOLIDAYS, TRAIN_HOLIDAYS

FULL_LAGS = feats.PROFILES["full"]["lags"]
BACK_LAGS = feats.PROFILES["backtest"]["lags"]


def _windows(spark, sf, columns):
    w = halo_window()
    rows = feats.with_day(with_halo(S.filled(spark, sf), feats.REACH), "demand_gw", w)
    return drop_halo(rows.withColumns(columns(w)))


def _lag_sql(lags, clamp=False) -> str:
    one = lambda k: f"lag(demand_gw, {k}) OVER w"
    first = "first_value(demand_gw) OVER w"
    pick = (lambda k: f"coalesce({one(k)}, {first})") if clamp else one
    return ", ".join(f"{pick(k)} AS demand_lag_{k}h" for k in lags)


def _roll_sql(names, partial=False) -> str:
    parts = []
    for key, fn, n in (("mean_24h", "avg", 24), ("std_24h", "stddev_samp", 24), ("mean_168h", "avg", 168)):
        if key in names:
            expr = f"{fn}(demand_gw) OVER w{n}"
            full = f"CASE WHEN count(demand_gw) OVER w{n} = {n} THEN {expr} END"
            parts.append(f"{f'coalesce({expr}, 0.0)' if partial else full} AS {names[key]}")
    return ", ".join(parts)


WINDOW_SQL = """WINDOW w AS (PARTITION BY series_id ORDER BY ts),
 w24 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
 w168 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)"""


def _spec(names) -> str:
    return "series_id ts:t demand_gw:f " + " ".join(f"{n}:f" for n in names)


@query("win_lags", _spec([f"demand_lag_{k}h" for k in FULL_LAGS]),
       f"SELECT *, {_lag_sql(FULL_LAGS)} FROM filled {WINDOW_SQL}", "filled")
def _(spark, sf):
    return _windows(spark, sf, lambda w: feats.lag_columns("demand_gw", FULL_LAGS, w))


MEANS = {"mean_24h": "roll_mean_24h", "mean_168h": "roll_mean_168h"}
STD = {"std_24h": "roll_std_24h"}
ROLLS = {**MEANS, **STD}


def _rolls(names, partial=False):
    return lambda w: {names[k]: v for k, v in feats.roll_columns(w, partial).items() if k in names}


@query("win_roll_mean", _spec(MEANS.values()), f"SELECT *, {_roll_sql(MEANS)} FROM filled {WINDOW_SQL}", "filled")
def _(spark, sf):
    return _windows(spark, sf, _rolls(MEANS))


@query("win_roll_std", _spec(STD.values()), f"SELECT *, {_roll_sql(STD)} FROM filled {WINDOW_SQL}", "filled")
def _(spark, sf):
    return _windows(spark, sf, _rolls(STD))


@query("win_roll_partial", _spec(ROLLS.values()),
       f"SELECT *, {_roll_sql(ROLLS, True)} FROM filled {WINDOW_SQL}", "filled")
def _(spark, sf):
    return _windows(spark, sf, _rolls(ROLLS, partial=True))


@query("win_lag_clamped", _spec([f"demand_lag_{k}h" for k in FULL_LAGS]),
       f"SELECT *, {_lag_sql(FULL_LAGS, True)} FROM filled {WINDOW_SQL}", "filled")
def _(spark, sf):
    return _windows(spark, sf, lambda w: feats.lag_columns("demand_gw", FULL_LAGS, w, clamp=True))


def features_sql(source: str, profile: str = "full", policy: str = "train", holidays=None) -> str:
    p = feats.PROFILES[profile]
    serve = policy == "serve"
    dates = holidays or {"train": TRAIN_HOLIDAYS, "backtest": BACKTEST_HOLIDAYS, "serve": SERVE_HOLIDAYS}[
        "serve" if serve else p["holidays"]]
    keep = "" if serve else f"WHERE {p['rolls']['mean_168h']} IS NOT NULL AND demand_lag_168h IS NOT NULL"
    return f"""
SELECT * FROM (
  SELECT series_id, ts, demand_gw, temperature_f, hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, month(ts) AS month,
    dayofyear(ts) AS dayofyear, week(ts) AS weekofyear, quarter(ts) AS quarter,
    CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, {_in_dates(dates)} AS is_holiday,
    {cyclic_sql()}, temperature_f * temperature_f AS temp_sq, greatest(0.0, temperature_f - 65) AS temp_cooling,
    greatest(0.0, 45 - temperature_f) AS temp_heating,
    {_lag_sql(p['lags'], serve)}, {_roll_sql(p['rolls'], serve)}, {GROWTH_SQL} AS data_center_load_gw
  FROM {source} {WINDOW_SQL}) {keep}"""


INTS = {"hour", "dayofweek", "month", "dayofyear", "weekofyear", "quarter", "is_weekend", "is_holiday"}


def feature_spec(profile: str) -> str:
    names = [f"{n}:{'i' if n in INTS else 'f'}" for n in feats.feature_names(profile)]
    return "series_id ts:t demand_gw:f temperature_f:f " + " ".join(names)


@query("win_features_full", feature_spec("full"), features_sql("canonical"), "canonical")
def _(spark, sf):
    return feats.build_features(S.canonical(spark, sf))


@query("win_features_backtest", feature_spec("backtest"), features_sql("canonical", "backtest"), "canonical")
def _(spark, sf):
    return feats.build_features(S.canonical(spark, sf), "backtest")


@query("win_features_serve", feature_spec("full"), features_sql("canonical", policy="serve"), "canonical")
def _(spark, sf):
    return feats.build_features(S.canonical(spark, sf), policy="serve", holidays="serve")


@query("win_features_by_user", feature_spec("full"), features_sql("canonical_user"), "canonical_user")
def _(spark, sf):
    from ..functions.weather import synthetic_temperature
    from ..operators.clean import gap_fill

    demand = gap_fill(S.by_user(spark, sf)).withColumn("temperature_f", synthetic_temperature(F.col("ts")))
    return feats.build_features(demand)


@query("win_halo", _spec(["demand_lag_168h", "roll_mean_168h"]), f"""
SELECT *, lag(demand_gw, 168) OVER w AS demand_lag_168h,
       CASE WHEN count(demand_gw) OVER w168 = 168 THEN avg(demand_gw) OVER w168 END AS roll_mean_168h
FROM filled {WINDOW_SQL}""", "filled")
def _(spark, sf):
    # Buckets barely wider than the reach, so that most rows are copied.
    w = halo_window()
    rows = feats.with_day(with_halo(S.filled(spark, sf), feats.REACH, width=200), "demand_gw", w)
    names = {"mean_168h": "roll_mean_168h"}
    return drop_halo(rows.withColumns({**feats.lag_columns("demand_gw", [168], w), **_rolls(names)(w)}))


@query("win_row_index", "series_id ts:t pos:i n:i part", """
SELECT series_id, ts, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n,
       CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 336 THEN 'tail' ELSE 'rest' END AS part
FROM hourly WINDOW w AS (PARTITION BY series_id ORDER BY ts)""", "hourly")
def _(spark, sf):
    rows = with_positions(S.hourly(spark, sf), width=240)
    part = F.when(F.col("_pos") >= F.col("_n") - 336, "tail").otherwise("rest")
    return rows.select("series_id", "ts", F.col("_pos").alias("pos"), F.col("_n").alias("n"), part.alias("part"))


# Sorts and top-k


@query("sort_by_time", "series_id ts:t demand_gw:f", "SELECT * FROM hourly ORDER BY series_id, ts", "hourly")
def _(spark, sf):
    return S.hourly(spark, sf).orderBy("series_id", "ts")


@query("topk_tail", "series_id ts:t demand_gw:f", """
SELECT series_id, ts, demand_gw FROM hourly
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 200""", "hourly")
def _(spark, sf):
    return rank.tail(S.hourly(spark, sf), 200)


@query("topk_tail_long", "series_id ts:t demand_gw:f", """
SELECT series_id, ts, demand_gw FROM daily
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 2000""", "daily")
def _(spark, sf):
    return rank.tail(S.daily(spark, sf), 2000)


@query("topk_head", "series_id ts:t demand_gw:f", """
SELECT series_id, ts, demand_gw FROM daily
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts) <= 30""", "daily")
def _(spark, sf):
    return rank.head(S.daily(spark, sf), 30)


# Importances: how much the series vary with each feature


IMPORTANCE_FEATURES = ["demand_lag_24h", "demand_lag_168h", "temperature_f", "hour", "dayofweek", "dayofyear"]


def _importances(spark, sf):
    """Absolute covariance of each candidate feature with demand, as an importance."""
    rows = _windows(spark, sf, lambda w: feats.lag_columns("demand_gw", [24, 168], w))
    from ..functions.calendar import calendar_columns
    from ..functions.weather import synthetic_temperature

    ts = F.col("ts")
    rows = rows.withColumn("temperature_f", synthetic_temperature(ts)).withColumns(
        {k: v for k, v in calendar_columns(ts).items() if k in IMPORTANCE_FEATURES})
    wide = rows.agg(*[F.abs(F.covar_samp("demand_gw", f)).alias(f) for f in IMPORTANCE_FEATURES])
    order = F.create_map(*[x for i, f in enumerate(IMPORTANCE_FEATURES) for x in (F.lit(f), F.lit(i))])
    return wide.unpivot([], IMPORTANCE_FEATURES, "feature", "importance").withColumn("feature_order", order[F.col("feature")])


cte("importances", f"""
SELECT feature, importance, list_position({IMPORTANCE_FEATURES}, feature) - 1 AS feature_order FROM (
  UNPIVOT (SELECT {", ".join(f"abs(covar_samp(demand_gw, {f})) AS {f}" for f in IMPORTANCE_FEATURES)}
    FROM (SELECT series_id, demand_gw, {_lag_sql([24, 168])}, {S.synthetic_sql()} AS temperature_f, hour(ts) AS hour,
                 isodow(ts) - 1 AS dayofweek, dayofyear(ts) AS dayofyear
          FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts)))
  ON {", ".join(IMPORTANCE_FEATURES)} INTO NAME feature VALUE importance)""", "filled")


@query("topk_importance", "feature importance:f rank:i is_lag above_median", """
SELECT *, contains(feature, 'lag') AS is_lag, importance > median(importance) OVER () AS above_median
FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, feature_order) AS rank FROM importances) WHERE rank <= 20
""", "importances")
def _(spark, sf):
    return rank.top_importance(_importances(spark, sf))


@query("sort_importance_share", "feature importance:f rank:i bar:i", """
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, feature_order) AS rank,
  floor(importance / max(importance) OVER () * 30) AS bar FROM importances) WHERE rank <= 10""", "importances")
def _(spark, sf):
    return rank.importance_share(_importances(spark, sf))

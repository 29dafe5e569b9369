"""Requests, seeds, recursion, folds, backtest windows and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.metrics import anchors
from ..operators.split import label_splits
from ..plans import backtest, evaluate, features as feats, forecast, forest, gate, intervals, lifecycle, models
from ..session import KEY, scratch, stored
from ..sources.publish import current
from ..sources.registry import load_runs
from . import series as S
from .core import cte, query
from .modelling import CHECKED, _fitted
from .scalars import _lagged
from .windows import features_sql

HOURS = 48
MODEL = forecast.LinearModel(intercept=20.0, lags={1: 0.2, 24: 0.3, 168: 0.15}, mean_24h=0.2)


def _requests(spark, sf):
    """Two requests per series: one open, one with a given start."""
    names = S.hourly(spark, sf).select(KEY).distinct()
    open_ = names.select(F.concat(F.lit("open-"), KEY).alias("request_id"), KEY, F.lit(HOURS).alias("hours"),
                         F.lit(None).cast("timestamp").alias("start_ts"))
    fixed = names.select(F.concat(F.lit("fixed-"), KEY).alias("request_id"), KEY, F.lit(24).alias("hours"),
                         F.lit("2024-02-10 06:00:00").cast("timestamp").alias("start_ts"))
    return open_.unionByName(fixed)


cte("served", """
SELECT * FROM requests UNION ALL SELECT 'new', 'no history', 12, TIMESTAMP '2024-02-10 06:00:00'""", "requests")


def _anchors(demand):
    return demand.groupBy(KEY).agg(F.max("ts").alias("anchor_ts"))


cte("requests", f"""
SELECT 'open-' || series_id AS request_id, series_id, {HOURS} AS hours, max(ts) + INTERVAL 1 HOUR AS start_ts
FROM hourly GROUP BY series_id UNION ALL
SELECT DISTINCT 'fixed-' || series_id, series_id, 24, TIMESTAMP '2024-02-10 06:00:00' FROM hourly""", "hourly")
cte("seeds", """
SELECT series_id, max(ts) AS last_ts, list(demand_gw ORDER BY ts) AS seed
FROM (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 200)
GROUP BY 1""", "filled")


@query("fc_requests", "request_id series_id step:i ts:t", """
SELECT request_id, series_id, step, start_ts + to_hours(step) AS ts
FROM (SELECT *, unnest(range(hours)) AS step FROM requests)""", "requests")
def _(spark, sf):
    return forecast.request_hours(forecast.resolve_requests(_requests(spark, sf), _anchors(S.hourly(spark, sf))))


@query("fc_seed", "series_id i:i v:f", """
SELECT series_id, i, seed[i] AS v FROM (SELECT series_id, seed, unnest(range(1, len(seed) + 1)) AS i FROM (
  SELECT series_id, seed FROM seeds UNION ALL SELECT 'no history', list_transform(range(200), lambda x: 50.0)))""", "seeds")
def _(spark, sf):
    demand = S.filled(spark, sf)
    wanted = demand.select(KEY).unionByName(demand.select(F.lit("no history").alias(KEY)))
    # The fresher store holds too few rows to be used.
    fresher = forecast.seed_arrays(demand.where("ts >= timestamp'2024-01-30 16:00:00'"))
    chosen = forecast.choose_seed(wanted, forecast.seed_arrays(demand), fresher)
    return chosen.select(KEY, F.posexplode("seed").alias("_i", "v")).withColumn("i", F.col("_i") + 1)


cte("bridged", """
SELECT series_id, list_concat(seed[gap + 1:], list_transform(range(gap), lambda x: list_avg(seed[-24:]))) AS seed
FROM (SELECT s.series_id, s.seed, date_diff('hour', s.last_ts, TIMESTAMP '2024-02-02 05:00:00') AS gap FROM seeds s)""", "seeds")


@query("fc_seed_bridge", "series_id i:i v:f", """
SELECT series_id, i, seed[i] AS v FROM (SELECT series_id, seed, unnest(range(1, len(seed) + 1)) AS i FROM bridged)""", "bridged")
def _(spark, sf):
    seeds = forecast.seed_arrays(S.filled(spark, sf))
    newer = seeds.select(KEY, F.lit("2024-02-02 05:00:00").cast("timestamp").alias("anchor_ts"))
    return forecast.bridge_seeds(seeds, newer).select(KEY, F.posexplode("seed").alias("_i", "v")).withColumn("i", F.col("_i") + 1)


def _step_sql(a: str) -> str:
    at = lambda k: f"{a}[greatest(len({a}) - {k - 1}, 1)]"
    lags = " + ".join(f"{at(k)} * {c}::DOUBLE" for k, c in MODEL.lags.items())
    return f"({MODEL.intercept}::DOUBLE + {lags} + list_avg({a}[-24:]) * {MODEL.mean_24h}::DOUBLE)"


def path_sql(history: str, hours: str) -> str:
    return (f"list_reduce(list_concat([{history}], list_transform(range({hours}), lambda h: [h::DOUBLE])), "
            f"lambda a, i: list_append(a, {_step_sql('a')}))[len({history}) + 1:]")


@query("fc_recursive", "request_id series_id step:i ts:t pred:f", f"""
SELECT request_id, series_id, step, start_ts + to_hours(step) AS ts, path[step + 1] AS pred
FROM (SELECT *, unnest(range(hours)) AS step FROM (
  SELECT r.*, {path_sql('s.seed', 'r.hours')} AS path FROM requests r JOIN seeds s ON r.series_id = s.series_id))""",
       "requests seeds")
def _(spark, sf):
    demand = S.filled(spark, sf)
    resolved = forecast.resolve_requests(_requests(spark, sf), _anchors(demand))
    return forecast.recursive_linear(resolved, forecast.seed_arrays(demand), MODEL)


@query("fc_request_pipeline", "request_id series_id step:i ts:t pred:f lower_gw:f upper_gw:f", f"""
SELECT request_id, series_id, step, start_ts + to_hours(step) AS ts, path[step + 1] AS pred,
  path[step + 1] - 0.62 AS lower_gw, path[step + 1] + 0.61 AS upper_gw
FROM (SELECT *, unnest(range(hours)) AS step FROM (
  SELECT *, list_reduce(list_concat([seed], list_transform(range(hours), lambda h: [h::DOUBLE])), lambda a, i:
      list_append(a, {{step}} + 0.05::DOUBLE * temps[i[1]::BIGINT + 1]))[len(seed) + 1:] AS path
  FROM (SELECT r.request_id, r.series_id, r.hours, r.start_ts, coalesce(any_value(s.seed), list_transform(range(200), lambda x: 50.0::DOUBLE)) AS seed,
          list(coalesce(f.temperature_f, {{proxy}}) ORDER BY h.ts) AS temps
        FROM served r LEFT JOIN seeds s ON r.series_id = s.series_id
        JOIN (SELECT request_id, start_ts + to_hours(unnest(range(hours))) AS ts FROM served) h ON h.request_id = r.request_id
        LEFT JOIN forecast f ON f.ts = h.ts GROUP BY ALL)))""".replace("{step}", _step_sql("a")).replace("{proxy}", S.synthetic_sql("h.ts", False)),
       "served seeds forecast")
def _(spark, sf):
    """Every request, also of a series without history, through the whole serving plan."""
    demand = S.filled(spark, sf)
    unknown = spark.createDataFrame([("new", "no history", 12, None)], "request_id string, series_id string, hours int, start_ts timestamp").withColumn(
        "start_ts", F.lit("2024-02-10 06:00:00").cast("timestamp"))
    model = forecast.LinearModel(MODEL.intercept, MODEL.lags, MODEL.mean_24h, temperature=0.05)
    return forecast.serve_requests(_requests(spark, sf).unionByName(unknown), demand, _anchors(demand), model,
                                   weather=S.temperature(spark, sf, "click"))


@query("fc_recursive_trees", "request_id series_id step:i ts:t pred:f")
def _(spark, sf):
    demand = S.canonical(spark, sf)
    model = forest.ForestModel.of(_fitted(spark, sf)[0])
    resolved = forecast.resolve_requests(_requests(spark, sf), _anchors(demand))
    return forecast.recursive_linear(resolved, forecast.seed_arrays(demand), model)


# A fixed ensemble, so that its SQL can be written down: lags, the day's mean and the hour.
FOREST = forest.Forest.build(
    ("demand_lag_24h", "demand_lag_168h", "demand_roll_mean_24h", "hour"),
    [{0: (0, 60.0, 1, 2, 0.0), 1: (1, 45.0, 3, 4, 0.0), 2: (3, 11.5, 5, 6, 0.0), 3: (-1, 0.0, -1, -1, 41.5), 4: (-1, 0.0, -1, -1, 52.25),
      5: (-1, 0.0, -1, -1, 66.0), 6: (2, 75.0, 7, 8, 0.0), 7: (-1, 0.0, -1, -1, 71.125), 8: (-1, 0.0, -1, -1, 83.0)},
     {0: (2, 64.0, 1, 2, 0.0), 1: (-1, 0.0, -1, -1, -3.5), 2: (0, 90.0, 3, 4, 0.0), 3: (-1, 0.0, -1, -1, 2.75), 4: (-1, 0.0, -1, -1, 6.0)},
     {0: (-1, 0.0, -1, -1, 0.5)}])


@query("ml_forest_score", "series_id ts:t actual:f pred:f", f"""
SELECT series_id, ts, demand_gw AS actual, {FOREST.sql({n: n for n in FOREST.inputs})} AS pred FROM features""", "features")
def _(spark, sf):
    scored = forest.score_forest(FOREST, feats.build_features(S.canonical(spark, sf)))
    return scored.select(KEY, "ts", F.col("demand_gw").alias("actual"), F.col("prediction").alias("pred"))


def _forest_step_sql(a: str, hour: str) -> str:
    at = lambda k: f"{a}[greatest(len({a}) - {k - 1}, 1)]"
    return FOREST.sql({"demand_lag_24h": at(24), "demand_lag_168h": at(168), "demand_roll_mean_24h": f"list_avg({a}[-24:])", "hour": hour})


@query("fc_recursive_forest", "request_id series_id step:i ts:t pred:f", f"""
SELECT request_id, series_id, step, start_ts + to_hours(step) AS ts, path[step + 1] AS pred
FROM (SELECT *, unnest(range(hours)) AS step FROM (
  SELECT r.*, list_reduce(list_concat([s.seed], list_transform(range(r.hours), lambda h: [h::DOUBLE])), lambda a, i:
    list_append(a, {_forest_step_sql('a', "((hour(r.start_ts) + i[1]::BIGINT) % 24)")}))[len(s.seed) + 1:] AS path
  FROM requests r JOIN seeds s ON r.series_id = s.series_id))""", "requests seeds")
def _(spark, sf):
    demand = S.filled(spark, sf)
    resolved = forecast.resolve_requests(_requests(spark, sf), _anchors(demand))
    return forecast.recursive_linear(resolved, forecast.seed_arrays(demand), forest.ForestModel(FOREST))


FILL_FEATURES = ["demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_roll_mean_24h", "demand_roll_std_24h",
                 "demand_roll_mean_168h"]
FILL_SPEC = "request_id series_id step:i ts:t " + " ".join(f"{f}:f" for f in FILL_FEATURES)


def _fill_sql(filler: str) -> str:
    at = lambda k: f"past[greatest(len(past) - {k - 1}, 1)]"
    return f"""
SELECT request_id, series_id, step, start_ts + to_hours(step) AS ts, {at(1)} AS demand_lag_1h, {at(24)} AS demand_lag_24h,
  {at(168)} AS demand_lag_168h, list_avg(past[-24:]) AS demand_roll_mean_24h,
  list_stddev_samp(past[-24:]) AS demand_roll_std_24h, list_avg(past[-168:]) AS demand_roll_mean_168h
FROM (SELECT *, list_concat(seed, list_transform(range(step), lambda x: filler)) AS past FROM (
  SELECT r.*, s.seed, {filler} AS filler, unnest(range(r.hours)) AS step
  FROM requests r JOIN seeds s ON r.series_id = s.series_id))"""


def _fill(spark, sf, policy):
    demand = S.filled(spark, sf)
    resolved = forecast.resolve_requests(_requests(spark, sf), _anchors(demand))
    return forecast.filled_horizon(resolved, forecast.seed_arrays(demand), policy)


@query("fc_zero_fill", FILL_SPEC, _fill_sql("0.0::DOUBLE"), "requests seeds")
def _(spark, sf):
    return _fill(spark, sf, "zero")


@query("fc_mean_fill", FILL_SPEC, _fill_sql("list_avg(s.seed[-168:])"), "requests seeds")
def _(spark, sf):
    return _fill(spark, sf, "mean")


@query("fc_interval", "request_id series_id step:i ts:t demand_gw:f lower_gw:f upper_gw:f")
def _(spark, sf):
    """Recursive path of the fitted model; bounds are scored in one batch once the path is known."""
    demand = S.canonical(spark, sf)
    rows = stored(label_splits(feats.build_features(demand), "2024-01-22", calibration=120), "features")
    names = feats.feature_names()
    fit = models.fit_leaf_quantiles(rows.where("split = 'train'"), names)
    offsets = intervals.conformal_offsets(fit.bounds(rows.where("split = 'calibration'")), actual="demand_gw")
    resolved = forecast.resolve_requests(_requests(spark, sf), _anchors(demand))
    fitted = models.fit_trees(rows.where("split = 'train'"), names, CHECKED)
    path = stored(forecast.recursive_linear(resolved, forecast.seed_arrays(demand), forest.ForestModel.of(fitted)), "paths")
    # Each request continues the history of its own series; requests do not see each other.
    ids = resolved.select("request_id", KEY)
    past = demand.join(ids, KEY).select("request_id", KEY, "ts", "demand_gw", F.lit(None).cast("int").alias("step"))
    grown = past.unionByName(path.withColumnRenamed("pred", "demand_gw")).withColumnRenamed(KEY, "_series").withColumnRenamed("request_id", KEY)
    featured = feats.build_features(grown, policy="serve", holidays="serve").where("step is not null")
    served = featured.withColumnRenamed(KEY, "request_id").withColumnRenamed("_series", KEY).fillna(0, subset=names)
    return intervals.widen(fit.bounds(served), offsets).select(
        "request_id", KEY, "step", "ts", "demand_gw", F.col("lower").alias("lower_gw"), F.col("upper").alias("upper_gw"))


@query("fc_precomputed", "series_id ts:t pred:f lower_gw:f upper_gw:f", """
SELECT series_id, ts, pred, pred - 0.62 AS lower_gw, pred + 0.61 AS upper_gw
FROM predictions WHERE model = 'naive_day' QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts) <= 72""", "predictions")
def _(spark, sf):
    return forecast.precomputed(S.predictions(spark, sf).where("model = 'naive_day'"), 72)


@query("fc_precomputed_summary", "series_id hours:i peak_gw:f avg_gw:f", """
SELECT series_id, count(*) AS hours, max(actual) AS peak_gw, avg(actual) AS avg_gw FROM (
  SELECT * FROM predictions WHERE model = 'naive_day'
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts) <= 72) GROUP BY 1""", "predictions")
def _(spark, sf):
    stored = S.predictions(spark, sf).where("model = 'naive_day'")
    return forecast.summarize(forecast.precomputed(stored, 72, use_actual=True), (KEY,))


# Folds over the daily order series: six and a half years

GEOMETRY = {"min_train": 100, "min_test": 10}


def fold_ctes(source: str, prefix: str) -> None:
    cte(f"{prefix}_origin", f"""
SELECT series_id, min(ts) AS s, max(ts) AS e, min(ts) + INTERVAL 12 MONTH AS o FROM {source} GROUP BY 1""", source)
    cte(f"{prefix}_candidates", f"""
SELECT series_id, s AS train_start, o + to_days(30 * k) AS test_start, o + to_days(30 * (k + 1)) AS test_end, k + 1 AS fold
FROM (SELECT *, unnest(range(greatest(date_diff('day', o, e) // 30 + 1, 0))) AS k FROM {prefix}_origin) WHERE o + to_days(30 * (k + 1)) <= e""", f"{prefix}_origin")
    cte(f"{prefix}_sized", f"""
SELECT c.series_id, c.fold, any_value(train_start) AS train_start, any_value(test_start) AS test_start,
       any_value(test_end) AS test_end, count(*) FILTER (d.ts < c.test_start) AS n_train,
       count(*) FILTER (d.ts >= c.test_start AND d.ts < c.test_end) AS n_test
FROM {prefix}_candidates c JOIN {source} d ON c.series_id = d.series_id GROUP BY 1, 2""", f"{prefix}_candidates", source)
    cte(f"{prefix}_folds", f"""
SELECT *, test_start AS train_end FROM (
  SELECT *, bool_and(n_train >= {GEOMETRY['min_train']} AND n_test >= {GEOMETRY['min_test']})
            OVER (PARTITION BY series_id ORDER BY fold) AS ok FROM {prefix}_sized) WHERE ok""", f"{prefix}_sized")


fold_ctes("daily", "daily")
FOLD_SPEC = "series_id fold:i train_start:d train_end:d test_start:d test_end:d n_train:i n_test:i"


@query("bt_fold_table", FOLD_SPEC, "SELECT * FROM daily_folds", "daily_folds")
def _(spark, sf):
    return backtest.fold_table(S.daily(spark, sf), **GEOMETRY)


@query("bt_fold_table_rolling", FOLD_SPEC, f"""
SELECT *, test_start AS train_end FROM (
  SELECT *, bool_and(n_train >= 100 AND n_test >= 10) OVER (PARTITION BY series_id ORDER BY fold) AS ok FROM (
    SELECT c.series_id, c.fold, any_value(c.train_start + to_days(30 * (c.fold - 1)::INT)) AS train_start, any_value(test_start) AS test_start,
       any_value(test_end) AS test_end,
       count(*) FILTER (d.ts < c.test_start AND d.ts >= c.train_start + to_days(30 * (c.fold - 1)::INT)) AS n_train,
       count(*) FILTER (d.ts >= c.test_start AND d.ts < c.test_end) AS n_test
    FROM daily_candidates c JOIN daily d ON c.series_id = d.series_id GROUP BY 1, 2)) WHERE ok""", "daily_candidates daily")
def _(spark, sf):
    return backtest.fold_table(S.daily(spark, sf), anchored=False, **GEOMETRY)


@query("join_fold_range", "series_id ts:t demand_gw:f fold:i", """
SELECT d.series_id, d.ts, d.demand_gw, f.fold FROM daily d JOIN daily_folds f
  ON d.series_id = f.series_id AND d.ts >= f.test_start AND d.ts < f.test_end""", "daily daily_folds")
def _(spark, sf):
    rows = S.daily(spark, sf)
    folds = backtest.fold_table(rows, **GEOMETRY).select(KEY, "segment", "fold")
    return backtest.assign_folds(rows).join(folds, [KEY, "segment"])


FOLD_METRICS = FOLD_SPEC + " mae:f rmse:f mape:f"
METRIC_SQL = """round(avg(abs(actual - pred)), 4) AS mae, round(sqrt(avg((actual - pred) * (actual - pred))), 4) AS rmse,
  round(avg(CASE WHEN actual <> 0 THEN abs((actual - pred) / actual) END) * 100, 4) AS mape"""
cte("daily_naive", """
SELECT * FROM (SELECT series_id, ts, demand_gw AS actual, lag(demand_gw, 7) OVER (PARTITION BY series_id ORDER BY ts) AS pred
FROM daily) WHERE pred IS NOT NULL""", "daily")
fold_ctes("daily_naive", "naive")
cte("fold_scores", f"""
SELECT f.*, {METRIC_SQL} FROM naive_folds f JOIN daily_naive d
  ON f.series_id = d.series_id AND d.ts >= f.test_start AND d.ts < f.test_end GROUP BY ALL""", "naive_folds", "daily_naive")


def _daily_naive(spark, sf):
    from ..operators.buckets import drop_halo, halo_window, with_halo, with_positions

    rows = with_halo(with_positions(S.daily(spark, sf)), 7, F.col("_pos"))
    lagged = drop_halo(rows.withColumn("pred", F.lag("demand_gw", 7).over(halo_window())))
    return lagged.where("pred is not null").select(KEY, "ts", F.col("demand_gw").alias("actual"), "pred")


@query("bt_walk_forward", FOLD_METRICS, "SELECT * FROM fold_scores", "fold_scores")
def _(spark, sf):
    return backtest.walk_forward_fixed(_daily_naive(spark, sf), **GEOMETRY)


@query("agg_backtest_summary", "series_id folds:i avg_mae:f avg_rmse:f avg_mape:f min_mape:f max_mape:f under_threshold:i over_threshold:i under_average:i", """
SELECT series_id, count(*) AS folds, avg(mae) AS avg_mae, avg(rmse) AS avg_rmse, avg(mape) AS avg_mape, min(mape) AS min_mape,
  max(mape) AS max_mape, count(*) FILTER (mape < 60) AS under_threshold, count(*) FILTER (mape >= 60) AS over_threshold,
  count(*) FILTER (mape < m) AS under_average
FROM (SELECT *, avg(mape) OVER (PARTITION BY series_id) AS m FROM fold_scores) GROUP BY 1""", "fold_scores")
def _(spark, sf):
    return backtest.summarize_folds(backtest.walk_forward_fixed(_daily_naive(spark, sf), **GEOMETRY), threshold=60.0)


cte("linear_rows", """
SELECT * FROM (SELECT series_id, ts, demand_gw AS actual, lag(demand_gw, 7) OVER (PARTITION BY series_id ORDER BY ts) AS x
FROM daily) WHERE x IS NOT NULL""", "daily")


@query("bt_walk_forward_linear", FOLD_METRICS, f"""
SELECT f.*, {METRIC_SQL} FROM naive_folds f JOIN (
  SELECT d.series_id, d.fold, t.ts, t.actual, d.a + d.b * t.x AS pred FROM (
    SELECT f.series_id, f.fold, f.test_start, f.test_end, regr_intercept(t.actual, t.x) AS a, regr_slope(t.actual, t.x) AS b
    FROM naive_folds f JOIN linear_rows t ON f.series_id = t.series_id AND t.ts < f.test_start GROUP BY ALL) d
  JOIN linear_rows t ON d.series_id = t.series_id AND t.ts >= d.test_start AND t.ts < d.test_end) s
ON f.series_id = s.series_id AND f.fold = s.fold GROUP BY ALL""", "naive_folds linear_rows")
def _(spark, sf):
    rows = _daily_naive(spark, sf).select(KEY, "ts", F.col("actual").alias("demand_gw"), F.col("pred").alias("x"))
    return backtest.walk_forward_linear(rows, ["x"], **GEOMETRY)


@query("bt_walk_forward_trees", FOLD_METRICS)
def _(spark, sf):
    rows = _daily_naive(spark, sf).withColumns({"dow": F.weekday("ts"), "month": F.month("ts")})
    names = ["pred", "dow", "month"]
    # One fit per fold, 67 of them: few rounds, all folds and rows.
    params = models.TreeParams(rounds=4, depth=3, step=0.3)

    def score(model, test):
        scored = models.score_trees(model, test)
        return scored.select(KEY, "segment", "actual", F.col("prediction").alias("pred"))

    return backtest.walk_forward_model(
        rows, lambda train, known: models.fit_trees(train, names, params, "actual", known=known), score,
        levels="actual", **GEOMETRY)


# Overlapping, irregular folds: one per series and day, of two to six days, purged by six hours.
@query("join_interval_folds", "series_id fold:d n:i mean:f", """
SELECT f.series_id, f.day AS fold, count(*) AS n, avg(h.demand_gw) AS mean
FROM (SELECT DISTINCT series_id, CAST(ts AS DATE) AS day FROM hourly) f JOIN filled h
  ON f.series_id = h.series_id AND h.ts >= f.day + INTERVAL 6 HOUR AND h.ts < f.day + to_days(CAST(2 + day(f.day) % 5 AS INT))
GROUP BY 1, 2""", "hourly filled")
def _(spark, sf):
    from ..operators.buckets import hour_index
    from ..operators.intervals import interval_join

    days = S.hourly(spark, sf).select(KEY, F.to_date("ts").alias("fold")).distinct()
    start = hour_index(F.col("fold").cast("timestamp"))
    rows = S.filled(spark, sf)
    met = interval_join(rows, days, hour_index("ts"), start + 6, start + 24 * (2 + F.dayofmonth("fold") % 5))
    return met.groupBy(KEY, "fold").agg(F.count("*").alias("n"), F.avg("demand_gw").alias("mean"))


# On-demand windows

DAYS = 10
cte("serve_features", features_sql("canonical", policy="serve"), "canonical")
cte("oracle_window", f"""
SELECT series_id, ts, demand_gw AS actual, 20.0 + 0.2 * demand_lag_1h + 0.3 * demand_lag_24h + 0.15 * demand_lag_168h
       + 0.2 * demand_roll_mean_24h AS pred
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r, count(*) OVER (PARTITION BY series_id) AS n
      FROM serve_features) WHERE r <= {DAYS * 24} AND n >= {DAYS * 24} + 168""", "serve_features")


def _oracle_pred(_):
    lags = {f"demand_lag_{k}h": c for k, c in MODEL.lags.items()}
    out = F.lit(MODEL.intercept) + F.col("demand_roll_mean_24h") * MODEL.mean_24h
    for name, c in lags.items():
        out = out + F.col(name) * c
    return out


WINDOW_SPEC = "series_id ts:t actual:f pred:f"


@query("bt_oracle_window", WINDOW_SPEC, "SELECT * FROM oracle_window", "oracle_window")
def _(spark, sf):
    return backtest.oracle_window(S.canonical(spark, sf), DAYS, _oracle_pred)


@query("bt_oracle_metrics", "series_id n_points:i mae_gw:f mape_pct:f rmse_gw:f", """
SELECT series_id, count(*) AS n_points, round(avg(abs(p - a)), 3) AS mae_gw,
  round(sum(CASE WHEN a <> 0 THEN abs(a - p) / a * 100 ELSE 0 END) / count(*), 2) AS mape_pct,
  round(sqrt(avg((p - a) * (p - a))), 3) AS rmse_gw
FROM (SELECT series_id, round(actual, 3) AS a, round(pred, 3) AS p FROM oracle_window) GROUP BY 1""", "oracle_window")
def _(spark, sf):
    return backtest.window_metrics(backtest.oracle_window(S.canonical(spark, sf), DAYS, _oracle_pred))


def _recursive_sql(chunk: int) -> str:
    n = DAYS * 24
    return f"""
SELECT series_id, ts, actual, path[i] AS pred FROM (
  SELECT series_id, path, unnest(test_ts) AS ts, unnest(test_v) AS actual, unnest(range(1, len(test_ts) + 1)) AS i FROM (
    SELECT series_id, c, test_ts, test_v, {path_sql('past', 'len(test_ts)')} AS path FROM (
      SELECT k.series_id, k.c,
        list(f.demand_gw ORDER BY f.ts) FILTER (f.pos < k.lo AND f.pos >= k.lo - 200) AS past,
        list(f.ts ORDER BY f.ts) FILTER (f.pos >= k.lo AND f.pos < k.lo + {chunk}) AS test_ts,
        list(f.demand_gw ORDER BY f.ts) FILTER (f.pos >= k.lo AND f.pos < k.lo + {chunk}) AS test_v
      FROM (SELECT series_id, c, count(*) - {n} + c * {chunk} AS lo
            FROM filled, range({-(-n // chunk)}) r(c) GROUP BY 1, 2 HAVING count(*) >= {n} + 168) k
      JOIN (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos FROM filled) f
        ON k.series_id = f.series_id GROUP BY 1, 2)))"""


@query("bt_recursive_window", WINDOW_SPEC, _recursive_sql(DAYS * 24), "filled")
def _(spark, sf):
    return backtest.recursive_window(S.filled(spark, sf), DAYS, MODEL)


@query("bt_recursive_reanchored", WINDOW_SPEC, _recursive_sql(72), "filled")
def _(spark, sf):
    return backtest.recursive_window(S.filled(spark, sf), DAYS, MODEL, reanchor_hours=72)


@query("bt_recursive_trees", WINDOW_SPEC)
def _(spark, sf):
    """The window forecast recursively by the fitted trees, which learned from rows before it."""
    demand = S.canonical(spark, sf)
    fitted = _fitted(spark, sf)[0]
    return backtest.recursive_window(demand, DAYS, forest.ForestModel.of(fitted))


@query("bt_oracle_vs_recursive", "series_id n:i dm_mean:f dm_statistic:f dm_pvalue:f dm_note")
def _(spark, sf):
    demand = S.canonical(spark, sf)
    oracle = backtest.oracle_window(demand, DAYS, _oracle_pred).withColumnRenamed("pred", "oracle")
    recursive = backtest.recursive_window(demand, DAYS, MODEL).select(KEY, "ts", F.col("pred").alias("recursive"))
    return evaluate.diebold_mariano_simple(oracle.join(recursive, [KEY, "ts"]))


# Gate

cte("gate_new", """
SELECT series_id, max(mape) FILTER (model = 'naive_day') AS new_mape, max(mape) FILTER (model = 'naive_week') AS baseline_mape
FROM model_metrics GROUP BY 1""", "model_metrics")
cte("gate", """
SELECT *, baseline_mape * 1.05 AS gate_limit,
       CASE WHEN new_mape <= baseline_mape * 1.05 THEN 'PROMOTED' ELSE 'REJECTED' END AS outcome FROM gate_new""", "gate_new")


def _gate_inputs(spark, sf):
    from ..operators.metrics import metrics_by_model

    scored = metrics_by_model(S.predictions(spark, sf))
    new = scored.where("model = 'naive_day'").select(KEY, F.col("mape").alias("new_mape"), F.lit("2024-01-30").cast("date").alias("new_end_date"))
    state = scored.where("model = 'naive_week'").select(
        KEY, F.lit("2024-01-01").cast("timestamp").alias("last_run"), F.lit("2024-01-01").cast("date").alias("last_end_date"),
        F.col("mape").alias("baseline_mape"))
    return new, state


@query("gate_decide", "series_id new_mape:f baseline_mape:f gate_limit:f outcome", "SELECT * FROM gate", "gate")
def _(spark, sf):
    return gate.decide(*_gate_inputs(spark, sf))


@query("gate_state", "series_id last_run:t last_end_date:d baseline_mape:f", """
SELECT series_id, CASE WHEN outcome = 'PROMOTED' THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS last_run,
  CASE WHEN outcome = 'PROMOTED' THEN DATE '2024-01-30' ELSE DATE '2024-01-01' END AS last_end_date,
  CASE WHEN outcome = 'PROMOTED' THEN new_mape ELSE baseline_mape END AS baseline_mape FROM gate""", "gate")
def _(spark, sf):
    new, state = _gate_inputs(spark, sf)
    return gate.next_state(gate.decide(new, state), state, "2024-02-01 00:00:00")


@query("gate_run", "series_id data_rows:i new_end_date:d new_mape:f baseline_mape:f gate_limit:f outcome")
def _(spark, sf):
    from ..operators.clean import gap_fill

    demand = S.canonical(spark, sf)
    existing = demand.where("ts < timestamp'2024-01-25'")
    increment = demand.where("ts > timestamp'2024-01-24'").drop("temperature_f")
    state = demand.select(KEY).distinct().select(KEY, F.lit(120.0).alias("baseline_mape"), F.lit("2024-01-24").cast("date").alias("last_end_date"))

    def fit_and_score(train, test):
        model = models.fit_trees(train, feats.feature_names(), CHECKED)
        return models.long_predictions(models.score_trees(model, test), "trees")

    return gate.retrain(existing, increment, state, "2024-01-22", fit_and_score)


# Two runs of the stored lifecycle with the value of the day before as the model.
def _mape_sql(end: str) -> str:
    return f"""SELECT series_id, avg(CASE WHEN demand_gw <> 0 THEN abs((demand_gw - demand_lag_24h) / demand_gw) END) * 100 AS mape
FROM features WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '{end}' GROUP BY 1"""


@query("gate_lifecycle", "series_id version:i runs:i last_end_date:d baseline_mape:f", f"""
SELECT a.series_id, 1 + CAST((SELECT count(*) > 0 FROM ({_mape_sql('2024-01-22')}) x JOIN ({_mape_sql('2024-02-01')}) y ON x.series_id = y.series_id
    AND y.mape <= x.mape * 1.05) AS INT) AS version, 2 AS runs,
  CASE WHEN b.mape <= a.mape * 1.05 THEN e.last ELSE DATE '2024-01-21' END AS last_end_date,
  CASE WHEN b.mape <= a.mape * 1.05 THEN b.mape ELSE a.mape END AS baseline_mape
FROM ({_mape_sql('2024-01-22')}) a JOIN ({_mape_sql('2024-02-01')}) b ON a.series_id = b.series_id
JOIN (SELECT series_id, CAST(max(ts) AS DATE) AS last FROM canonical GROUP BY 1) e ON e.series_id = a.series_id""", "features canonical")
def _(spark, sf):
    """Published state after a first run on three weeks and a second one that starts from its end date."""
    demand = S.canonical(spark, sf)
    root = scratch(spark, "lifecycle")
    wide = demand.select(KEY).distinct().select(KEY, F.lit(1e9).alias("baseline_mape"), F.lit("2024-01-10").cast("date").alias("last_end_date"),
                                                F.lit(None).cast("timestamp").alias("last_run"))

    def naive(train, test):
        pred = test.select(KEY, "ts", F.col("demand_gw").alias("actual"), F.lit("naive").alias("model"), F.col("demand_lag_24h").alias("pred"))
        return lifecycle.Fitted(pred, lambda path: train.select(F.max("ts")).toDF("trained_to").write.parquet(path))

    rows = demand.drop("temperature_f")
    for upto, run_ts, state in (("2024-01-22", "2024-02-02 00:00:00", wide), ("2024-02-01", "2024-02-03 00:00:00", None)):
        increment = rows.where(F.col("ts") < F.lit(upto).cast("timestamp"))
        lifecycle.run_retrain(spark, root, demand.where("ts < timestamp'2024-01-11'"), increment, run_ts, "2024-01-15", naive, state)
    version = current(spark, root)
    runs = load_runs(spark, f"{root}/registry").count()
    return lifecycle.published_state(spark, root).select(KEY, F.lit(version.version).alias("version"), F.lit(runs).alias("runs"), "last_end_date", "baseline_mape")

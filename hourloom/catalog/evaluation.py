"""Metrics, quantiles, residual diagnostics and accuracy tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.clean import resample_daily_mean
from ..operators.joins import join_by_date
from ..operators.quantile import quantiles
from ..operators.rank import head, tail
from ..plans import evaluate, forecast
from ..session import KEY
from . import series as S
from .core import cte, query
from .scalars import ppf_sql, two_sided_p_sql

def actual():
    return F.col("actual")


def pred():
    return F.col("pred")


@query("agg_mae", "series_id model mae:f", "SELECT * FROM model_metrics", "model_metrics")
def _(spark, sf):
    return S.predictions(spark, sf).groupBy(KEY, "model").agg(metrics.mae(actual(), pred()).alias("mae"))


@query("agg_rmse", "series_id model rmse:f", "SELECT * FROM model_metrics", "model_metrics")
def _(spark, sf):
    return S.predictions(spark, sf).groupBy(KEY, "model").agg(metrics.rmse(actual(), pred()).alias("rmse"))


@query("agg_mape", "series_id model mape:f", "SELECT * FROM model_metrics", "model_metrics")
def _(spark, sf):
    return S.predictions(spark, sf).groupBy(KEY, "model").agg(metrics.mape(actual(), pred()).alias("mape"))


@query("agg_mape_alln", "series_id model mape:f", """
SELECT series_id, model, sum(CASE WHEN actual <> 0 THEN abs(actual - pred) / actual * 100 ELSE 0 END) / count(*) AS mape
FROM predictions GROUP BY 1, 2""", "predictions")
def _(spark, sf):
    return S.predictions(spark, sf).groupBy(KEY, "model").agg(metrics.mape_all_rows(actual(), pred()).alias("mape"))


BY_MODEL = " ".join(f"{m}_{x}:f" for m in S.NAIVE for x in ("mae", "rmse", "mape"))


@query("agg_metrics_by_model", f"series_id {BY_MODEL}", f"""
SELECT series_id, {", ".join(f"max({x}) FILTER (model = '{m}') AS {m}_{x}" for m in S.NAIVE for x in ("mae", "rmse", "mape"))}
FROM model_metrics GROUP BY 1""", "model_metrics")
def _(spark, sf):
    return metrics.compare_models(S.predictions(spark, sf), list(S.NAIVE))


@query("agg_forecast_summary", "series_id model hours:i peak_gw:f avg_gw:f", """
SELECT series_id, model, count(*) AS hours, max(pred) AS peak_gw, avg(pred) AS avg_gw FROM predictions GROUP BY 1, 2""",
       "predictions")
def _(spark, sf):
    return forecast.summarize(S.predictions(spark, sf), (KEY, "model"))


@query("agg_profile", "series_id n_rows:i min_value:f max_value:f first_ts:t last_ts:t", """
SELECT series_id, count(*) AS n_rows, min(demand_gw) AS min_value, max(demand_gw) AS max_value, min(ts) AS first_ts,
       max(ts) AS last_ts FROM hourly GROUP BY 1""", "hourly")
def _(spark, sf):
    return metrics.profile(S.hourly(spark, sf))


@query("agg_prediction_range", "series_id model lo:f hi:f", """
SELECT series_id, model, min(pred) AS lo, max(pred) AS hi FROM predictions GROUP BY 1, 2""", "predictions")
def _(spark, sf):
    return S.predictions(spark, sf).groupBy(KEY, "model").agg(F.min("pred").alias("lo"), F.max("pred").alias("hi"))


@query("agg_anchor", "series_id anchor_ts:t", """
SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(b.ts, a.ts) AS anchor_ts
FROM (SELECT series_id, max(ts) AS ts FROM hourly WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1) a
FULL JOIN (SELECT series_id, max(ts) AS ts FROM hourly WHERE demand_gw > 600 GROUP BY 1) b
  ON a.series_id = b.series_id""", "hourly")
def _(spark, sf):
    rows = S.hourly(spark, sf)
    return metrics.anchors(rows.where("ts < timestamp'2024-01-20'"), rows.where("demand_gw > 600"))


@query("agg_coverage", "series_id model coverage:f", """
SELECT series_id, model, avg(CASE WHEN actual BETWEEN pred - 60 AND pred + 60 THEN 1.0 ELSE 0.0 END) * 100 AS coverage
FROM predictions GROUP BY 1, 2""", "predictions")
def _(spark, sf):
    return S.predictions(spark, sf).groupBy(KEY, "model").agg(metrics.coverage(actual(), pred() - 60, pred() + 60).alias("coverage"))


cte("resid", "SELECT *, actual - pred AS residual FROM predictions", "predictions")
QS = [0.1, 0.25, 0.5, 0.8, 0.9]


@query("agg_quantile_linear", "series_id model level:f value:f", " UNION ALL ".join(
    f"SELECT series_id, model, {q} AS level, quantile_cont(residual, {q}) AS value FROM resid GROUP BY 1, 2" for q in QS),
       "resid")
def _(spark, sf):
    return quantiles(evaluate.residuals(S.predictions(spark, sf)), [KEY, "model"], "residual", QS)


@query("agg_quantile_events", "event_type level:f value:f", " UNION ALL ".join(
    f"SELECT event_type, {q} AS level, quantile_cont(value, {q}) AS value FROM events GROUP BY 1" for q in QS))
def _(spark, sf):
    return quantiles(S.events(spark, sf), ["event_type"], "value", QS)


def histogram_sql(source: str, value: str, bins: int, keys: str) -> str:
    return f"""
SELECT {keys}, bin, lo + bin * ((hi - lo) / {bins}) AS bin_lo, count(*) AS n FROM (
  SELECT {keys}, lo, hi, least(CAST(floor(({value} - lo) / ((hi - lo) / {bins})) AS BIGINT), {bins - 1}) AS bin
  FROM (SELECT *, min({value}) OVER (PARTITION BY {keys}) AS lo, max({value}) OVER (PARTITION BY {keys}) AS hi FROM {source}))
GROUP BY ALL"""


@query("agg_histogram", "series_id model bin:i bin_lo:f n:i", histogram_sql("resid", "residual", 60, "series_id, model"), "resid")
def _(spark, sf):
    return metrics.histogram(evaluate.residuals(S.predictions(spark, sf)), "residual", 60, (KEY, "model"))


@query("agg_autocov1", "series_id autocov1:f", """
SELECT series_id, covar_samp(demand_gw, p) AS autocov1
FROM (SELECT *, lag(demand_gw) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM hourly) GROUP BY 1""", "hourly")
def _(spark, sf):
    return metrics.autocov1(S.hourly(spark, sf), "demand_gw")


def _day_residuals(spark, sf):
    return evaluate.residuals(S.predictions(spark, sf).where("model = 'naive_day'"))


cte("day_resid", "SELECT series_id, ts, actual, pred, residual FROM resid WHERE model = 'naive_day'", "resid")
cte("qq", f"""
SELECT series_id, rank, {ppf_sql('p')} AS theoretical, residual AS ordered FROM (
  SELECT series_id, rank, residual, CASE WHEN rank = n THEN pow(0.5, 1.0 / n) WHEN rank = 1 THEN 1.0 - pow(0.5, 1.0 / n)
    ELSE CAST(rank - 0.3175 AS DOUBLE) / CAST(n + 0.365 AS DOUBLE) END AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY residual) AS rank,
               count(*) OVER (PARTITION BY series_id) AS n FROM day_resid))""", "day_resid")


@query("ev_residuals", "series_id rank:i theoretical:f ordered:f", "SELECT * FROM qq", "qq")
def _(spark, sf):
    return evaluate.qq_points(_day_residuals(spark, sf))


@query("ev_residuals_fit", "series_id slope:f intercept:f r:f", """
SELECT series_id, regr_slope(ordered, theoretical) AS slope, regr_intercept(ordered, theoretical) AS intercept,
       corr(ordered, theoretical) AS r FROM qq GROUP BY 1""", "qq")
def _(spark, sf):
    return evaluate.qq_fit(evaluate.qq_points(_day_residuals(spark, sf)))


cte("daily_pred", """
SELECT series_id, ts, demand_gw, lag(demand_gw) OVER (PARTITION BY series_id ORDER BY ts) AS pred
FROM (SELECT series_id, date_trunc('day', ts) AS ts, avg(demand_gw) AS demand_gw FROM filled GROUP BY 1, 2)""", "filled")
cte("loss_diff", """
SELECT h.series_id, h.ts, (h.actual - h.pred) * (h.actual - h.pred)
       - (d.demand_gw - d.pred) * (d.demand_gw - d.pred) AS d
FROM (SELECT * FROM predictions WHERE model = 'naive_day') h JOIN daily_pred d
  ON h.series_id = d.series_id AND date_trunc('day', h.ts) = d.ts WHERE d.pred IS NOT NULL""", "predictions", "daily_pred")
cte("dm", """
SELECT *, d_bar / sqrt(greatest((gamma0 + gamma1 * 2) / n, 1e-12)) AS dm_stat FROM (
  SELECT series_id, count(d) AS n, avg(d) AS d_bar, var_samp(d) AS gamma0, coalesce(covar_samp(d, p), 0) AS gamma1
  FROM (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM loss_diff) GROUP BY 1)""", "loss_diff")


def _loss_diff(spark, sf):
    from ..plans.seasonal import day_index
    from ..operators.buckets import drop_halo, halo_window, with_halo

    demand = S.filled(spark, sf)
    daily = resample_daily_mean(demand)
    daily = drop_halo(with_halo(daily, 1, day_index()).withColumn("daily_pred", F.lag("demand_gw").over(halo_window())))
    hourly = S.naive_predictions(demand).where("model = 'naive_day'").select(KEY, "ts", "actual", "pred")
    merged = join_by_date(hourly, daily.where("daily_pred is not null"))
    return evaluate.loss_differential(merged, actual() - pred(), F.col("demand_gw") - F.col("daily_pred"))


@query("ev_dm_hac", "series_id n:i d_bar:f dm_stat:f p_value:f reject verdict", f"""
SELECT *, p_value < 0.05 AS reject, CASE WHEN dm_stat < 0 AND p_value < 0.05
  THEN 'hourly significantly outperforms daily' ELSE 'No statistically significant difference' END AS verdict
FROM (SELECT *, {two_sided_p_sql('dm_stat')} AS p_value FROM dm)""", "dm")
def _(spark, sf):
    return evaluate.diebold_mariano(_loss_diff(spark, sf), "hourly", "daily")


@query("ev_dm_histogram", "series_id bin:i bin_lo:f n:i", histogram_sql("loss_diff", "d", 50, "series_id"), "loss_diff")
def _(spark, sf):
    return metrics.histogram(_loss_diff(spark, sf), "d", 50)


def _paired(spark, sf):
    return S.predictions(spark, sf).groupBy(KEY, "ts").agg(
        F.max("actual").alias("actual"),
        F.max(F.when(F.col("model") == "naive_day", pred())).alias("oracle"),
        F.max(F.when(F.col("model") == "naive_week", pred())).alias("recursive"),
    ).dropna()


cte("paired", """
SELECT d.series_id, d.ts, d.actual, d.pred AS oracle, w.pred AS recursive FROM predictions d JOIN predictions w
  ON d.series_id = w.series_id AND d.ts = w.ts AND d.model = 'naive_day' AND w.model = 'naive_week'""", "predictions")


@query("ev_dm_simple", "series_id n:i dm_mean:f dm_statistic:f", """
SELECT series_id, count(*) AS n, avg(d) AS dm_mean, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS dm_statistic
FROM (SELECT series_id, pow(round(round(oracle, 3) - round(actual, 3), 3), 2)
             - pow(round(round(recursive, 3) - round(actual, 3), 3), 2) AS d FROM paired) GROUP BY 1""", "paired")
def _(spark, sf):
    return evaluate.diebold_mariano_simple(_paired(spark, sf))


# The tail by Simpson's rule over the angle whose tangent is t / sqrt(dof): independent of the fraction.
_T_TAIL = """
SELECT series_id, dm_mean, 2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * sum(
    CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos(low + k * (pi() / 2 - low) / 20000), dof - 1)) * (pi() / 2 - low) / 60000 AS dm_pvalue
FROM (SELECT series_id, dm_mean, n - 1.0 AS dof, atan(abs(dm_mean) / (sd / sqrt(n)) / sqrt(n - 1.0)) AS low
      FROM (SELECT series_id, count(*)::DOUBLE AS n, avg(d) AS dm_mean, stddev_samp(d) AS sd
            FROM (SELECT series_id, pow(round(round(oracle, 3) - round(actual, 3), 3), 2)
                         - pow(round(round(recursive, 3) - round(actual, 3), 3), 2) AS d FROM paired) GROUP BY 1)), range(20001) r(k)
GROUP BY series_id, dm_mean, dof, low"""


@query("ev_dm_simple_p", "series_id dm_pvalue:f dm_note", f"""
SELECT series_id, dm_pvalue, CASE
  WHEN dm_pvalue < 0.01 AND dm_mean < 0 THEN 'Oracle significantly more accurate (p<0.01)'
  WHEN dm_pvalue < 0.05 AND dm_mean < 0 THEN printf('Oracle marginally better (p=%.4f)', dm_pvalue)
  WHEN dm_pvalue < 0.05 AND dm_mean > 0 THEN printf('Recursive outperforms oracle (p=%.4f)', dm_pvalue)
  ELSE printf('No significant difference (p=%.4f)', dm_pvalue) END AS dm_note FROM ({_T_TAIL})""", "paired")
def _(spark, sf):
    return evaluate.diebold_mariano_simple(_paired(spark, sf))


def _curve_sql() -> str:
    halves = [(level, (1 - level) / 2) for level in evaluate.LEVELS]
    qs = ", ".join(f"{h!r}::DOUBLE, {1 - h!r}::DOUBLE" for _, h in halves)
    picks = " UNION ALL ".join(
        f"SELECT series_id, residual, {level!r} AS nominal, qs[{2 * i + 1}] AS lo, qs[{2 * i + 2}] AS hi FROM ends"
        for i, (level, _) in enumerate(halves))
    return f"""
SELECT series_id, nominal, any_value(lo) AS lo, any_value(hi) AS hi,
       avg(CASE WHEN residual >= lo AND residual <= hi THEN 1.0 ELSE 0.0 END) AS empirical
FROM (WITH ends AS (SELECT r.series_id, r.residual, e.qs FROM day_resid r JOIN (
        SELECT series_id, quantile_cont(residual, [{qs}]) AS qs FROM day_resid GROUP BY 1) e ON r.series_id = e.series_id)
      {picks}) GROUP BY 1, 2"""


cte("curve", _curve_sql(), "day_resid")


@query("ev_calibration_curve", "series_id nominal:f lo:f hi:f empirical:f", "SELECT * FROM curve", "curve")
def _(spark, sf):
    return evaluate.calibration_curve(_day_residuals(spark, sf))


@query("ev_calibration_at_80", "series_id nominal:f empirical:f", "SELECT * FROM curve WHERE nominal = 0.8", "curve")
def _(spark, sf):
    return evaluate.at_level(evaluate.calibration_curve(_day_residuals(spark, sf)))


@query("ev_calibration_held_out", "series_id nominal:f empirical:f")
def _(spark, sf):
    return evaluate.calibration_curve_held_out(_day_residuals(spark, sf), F.col("ts") < F.lit("2024-01-20"))


@query("ev_forecast_slices", "part series_id ts:t actual:f pred:f", """
SELECT 'hourly' AS part, series_id, ts, actual, pred FROM day_resid
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 336
UNION ALL
SELECT 'daily', series_id, ts, demand_gw, pred FROM daily_pred
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts) <= 30""", "day_resid daily_pred")
def _(spark, sf):
    from ..plans.seasonal import day_index
    from ..operators.buckets import drop_halo, halo_window, with_halo

    last = tail(_day_residuals(spark, sf), 14 * 24).select(F.lit("hourly").alias("part"), KEY, "ts", "actual", "pred")
    daily = resample_daily_mean(S.filled(spark, sf))
    daily = drop_halo(with_halo(daily, 1, day_index()).withColumn("pred", F.lag("demand_gw").over(halo_window())))
    first = head(daily, 30).select(F.lit("daily").alias("part"), KEY, "ts", F.col("demand_gw").alias("actual"), "pred")
    return last.unionByName(first)

"""Model fitting, scoring, intervals and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clean import resample_daily_mean
from ..operators.split import label_splits, temporal_split
from ..plans import features as feats
from ..plans import forest_quantiles, intervals, linear, models, seasonal
from ..session import KEY, stored
from . import series as S
from .core import cte, query
from .scalars import _lagged
from .windows import features_sql

# Full depth and inputs; the number of rounds is the only thing smaller than in plans.models.
CHECKED = models.TreeParams(rounds=20, depth=6, step=0.2)
CUT = "2024-01-22"


def _features(spark, sf):
    """Stored once per query: fits and scores scan it, instead of planning 32 windows again."""
    return stored(feats.build_features(S.canonical(spark, sf)), "features")


def _fitted(spark, sf):
    train, test = temporal_split(_features(spark, sf), CUT)
    return models.fit_trees(train, feats.feature_names(), CHECKED), train, test


@query("ml_point_fit", "series_id mae:f rmse:f mape:f")
def _(spark, sf):
    from ..operators.metrics import metrics_by_model

    model, _, test = _fitted(spark, sf)
    return metrics_by_model(models.long_predictions(models.score_trees(model, test), "trees"), (KEY,))


@query("ml_point_score", "series_id ts:t actual:f model pred:f")
def _(spark, sf):
    model, _, test = _fitted(spark, sf)
    return models.long_predictions(models.score_trees(model, test), "trees")


@query("ml_feature_importance", "feature importance:f feature_order:i")
def _(spark, sf):
    return models.feature_importance(_fitted(spark, sf)[0])


@query("ml_permutation_importance", "feature importance:f rows:i")
def _(spark, sf):
    model, _, test = _fitted(spark, sf)
    return models.permutation_importance(model, test, feats.feature_names())


@query("ml_quantile_fit", "series_id ts:t demand_gw:f lower:f median:f upper:f")
def _(spark, sf):
    train, test = temporal_split(_features(spark, sf), CUT)
    return forest_quantiles.fit_forest_quantiles(train, feats.feature_names()).bounds(test)


@query("ml_quantile_conformal", "series_id raw_coverage:f coverage:f")
def _(spark, sf):
    """Leaf quantiles widened by split-conformal offsets, with the coverage before and after."""
    from ..operators.metrics import coverage

    rows = label_splits(_features(spark, sf), CUT, calibration=120)
    fit = models.fit_leaf_quantiles(rows.where("split = 'train'"), feats.feature_names())
    offsets = intervals.conformal_offsets(fit.bounds(rows.where("split = 'calibration'")), actual="demand_gw")
    test = intervals.widen(fit.bounds(rows.where("split = 'test'")), offsets)
    y, off = F.col("demand_gw"), F.col("conformal_offset")
    return test.groupBy(KEY).agg(
        coverage(y, F.col("lower") + off, F.col("upper") - off).alias("raw_coverage"),
        coverage(y, F.col("lower"), F.col("upper")).alias("coverage"),
    )


cte("band", """
SELECT series_id, ts, demand_gw AS actual, least(demand_lag_24h, demand_lag_168h) AS lower,
       greatest(demand_lag_24h, demand_lag_168h) AS upper,
       CASE WHEN ts >= TIMESTAMP '2024-01-22' THEN 'test'
            WHEN row_number() OVER (PARTITION BY series_id, ts < TIMESTAMP '2024-01-22' ORDER BY ts DESC) <= 240
            THEN 'calibration' ELSE 'train' END AS split
FROM lagged WHERE demand_lag_168h IS NOT NULL""", "lagged")
cte("offsets", """
SELECT series_id, v[CAST(floor(pos) AS BIGINT) + 1]
       + (v[CAST(ceil(pos) AS BIGINT) + 1] - v[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos)) AS conformal_offset
FROM (SELECT series_id, list_sort(list(s)) AS v,
             least(ceil((count(*) + 1) * 0.8::DOUBLE) / count(*), 1.0) * (count(*) - 1) AS pos
      FROM (SELECT series_id, greatest(lower - actual, actual - upper) AS s FROM band WHERE split = 'calibration')
      GROUP BY 1)""", "band")


def _band(spark, sf):
    rows = _lagged(spark, sf).where("demand_lag_168h is not null").select(
        KEY, "ts", F.col("demand_gw").alias("actual"),
        F.least("demand_lag_24h", "demand_lag_168h").alias("lower"),
        F.greatest("demand_lag_24h", "demand_lag_168h").alias("upper"))
    return stored(label_splits(rows, CUT, calibration=240), "band")


@query("ml_conformal", "series_id ts:t actual:f lower:f upper:f conformal_offset:f", """
SELECT b.series_id, b.ts, b.actual, b.lower - conformal_offset AS lower, b.upper + conformal_offset AS upper,
       conformal_offset
FROM band b JOIN offsets o ON b.series_id = o.series_id WHERE b.split = 'test'""", "band offsets")
def _(spark, sf):
    rows = _band(spark, sf)
    offsets = intervals.conformal_offsets(rows.where("split = 'calibration'"))
    return intervals.widen(rows.where("split = 'test'"), offsets)


@query("ml_const_band", "series_id ts:t model pred:f lower_gw:f upper_gw:f", """
SELECT series_id, ts, model, pred, pred - 0.62 AS lower_gw, pred + 0.61 AS upper_gw FROM predictions""", "predictions")
def _(spark, sf):
    return intervals.const_band(S.predictions(spark, sf))


def _daily_mean(spark, sf):
    return resample_daily_mean(S.filled(spark, sf))


@query("ml_seasonal_diff", "series_id ts:t demand_gw:f w:f", """
SELECT *, demand_gw - lag(demand_gw, 1) OVER o - lag(demand_gw, 7) OVER o + lag(demand_gw, 8) OVER o AS w
FROM (SELECT series_id, date_trunc('day', ts) AS ts, avg(demand_gw) AS demand_gw FROM filled GROUP BY 1, 2)
WINDOW o AS (PARTITION BY series_id ORDER BY ts)""", "filled")
def _(spark, sf):
    return seasonal.seasonal_diff(_daily_mean(spark, sf))


def _daily_filled(spark, sf):
    """Daily order totals with missing days interpolated: long enough for the seasonal model."""
    from ..operators.clean import gap_fill

    return gap_fill(S.daily(spark, sf), step="1 day")


@query("ml_sarima_fit", "series_id ar1:f ar7:f ar8:f ma1:f ma7:f ma8:f sigma2:f aic:f bic:f n:i")
def _(spark, sf):
    fit = seasonal.fit_seasonal(_daily_filled(spark, sf))
    names = ["intercept", "ar1", "ar7", "ar8", "ma1", "ma7", "ma8"]
    return fit.select("*", *[F.col("coefs")[i].alias(n) for i, n in enumerate(names)])


@query("ml_sarima_forecast", "series_id ts:t pred:f")
def _(spark, sf):
    return seasonal.forecast_seasonal(_daily_filled(spark, sf), 30)


@query("ml_ols_moments", "series_id intercept:f slope:f n:i", """
SELECT series_id, regr_intercept(demand_gw, demand_lag_24h) AS intercept, regr_slope(demand_gw, demand_lag_24h) AS slope,
       regr_count(demand_gw, demand_lag_24h) AS n FROM lagged GROUP BY 1""", "lagged")
def _(spark, sf):
    fit = linear.fit_ols(_lagged(spark, sf), ["demand_lag_24h"], "demand_gw")
    return fit.select(KEY, F.col("coefs")[0].alias("intercept"), F.col("coefs")[1].alias("slope"), "n")


COEFS = {"demand_lag_24h": 0.4, "demand_lag_168h": 0.3}
cte("attr", f"""
SELECT series_id, ts, {", ".join(f"{c}::DOUBLE * ({f} - avg({f}) OVER (PARTITION BY series_id)) AS {f}" for f, c in COEFS.items())}
FROM (SELECT series_id, ts, coalesce(demand_lag_24h, 0) AS demand_lag_24h, coalesce(demand_lag_168h, 0) AS demand_lag_168h
      FROM lagged QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 3000)""", "lagged")


@query("ml_linear_shap", "series_id feature importance:f", " UNION ALL ".join(
    f"SELECT series_id, '{f}' AS feature, avg(abs({f})) AS importance FROM attr GROUP BY 1" for f in COEFS), "attr")
def _(spark, sf):
    return models.mean_attribution(_lagged(spark, sf), COEFS)


@query("ml_attribution_long", "series_id ts:t feature attribution:f", " UNION ALL ".join(
    f"SELECT series_id, ts, '{f}' AS feature, {f} AS attribution FROM attr" for f in COEFS), "attr")
def _(spark, sf):
    return models.attribution_long(_lagged(spark, sf), COEFS)


CONTEXT = ["demand_lag_1h", "demand_lag_168h", "demand_roll_mean_24h", "demand_roll_std_24h", "demand_roll_mean_168h"]


@query("ml_context_window", "series_id ts:t demand_gw:f " + " ".join(f"{c}:f" for c in CONTEXT), f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos,
                      count(*) OVER (PARTITION BY series_id) AS n FROM ({features_sql("canonical", policy="serve")}))
WHERE pos >= n - least(2000, n - 168)""", "canonical")
def _(spark, sf):
    return models.context_window(S.canonical(spark, sf))

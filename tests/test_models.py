import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourloom.functions import stats
from hourloom.operators.joins import fill_temperature
from hourloom.plans import evaluate, gate, intervals, linear, models, seasonal
from hourloom.plans.features import build_features

from .helpers import collect, demand


def test_ols_equals_lstsq(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"series_id": ["a"] * 80 + ["b"] * 80, "x": rng.normal(size=160), "z": rng.normal(size=160)})
    pdf["y"] = 2 + 3 * pdf.x - pdf.z + rng.normal(size=160)
    got = linear.fit_ols(spark.createDataFrame(pdf), ["x", "z"], "y").toPandas().set_index("series_id")
    for s, part in pdf.groupby("series_id"):
        X = np.column_stack([np.ones(len(part)), part.x, part.z])
        beta, rss, *_ = np.linalg.lstsq(X, part.y, rcond=None)
        np.testing.assert_allclose(got.loc[s, "coefs"], beta, rtol=1e-8)
        assert got.loc[s, "rss"] == pytest.approx(rss[0]) and got.loc[s, "n"] == 80


def test_conformal_offset_equals_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"series_id": "a", "actual": rng.normal(size=97)}).assign(lower=-0.5, upper=0.6)
    got = intervals.conformal_offsets(spark.createDataFrame(pdf)).head().conformal_offset
    score = np.maximum(pdf.lower - pdf.actual, pdf.actual - pdf.upper)
    q = min(np.ceil(98 * 0.8) / 97, 1.0)
    assert got == pytest.approx(np.quantile(score, q))


def test_seasonal_model_recovers_structure(spark):
    rng = np.random.default_rng(2)
    n, e = 900, rng.normal(size=920)
    w = np.zeros(920)
    for t in range(8, 920):
        w[t] = 0.5 * w[t - 1] + e[t] - 0.4 * e[t - 7]
    y = np.zeros(920)
    for t in range(8, 920):
        y[t] = w[t] + y[t - 1] + y[t - 7] - y[t - 8]
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2020-01-01", periods=n), "demand_gw": y[20:][:n]})
    df = spark.createDataFrame(pdf)
    fit = seasonal.fit_seasonal(df).head()
    assert fit.coefs[1] == pytest.approx(0.5, abs=0.15) and fit.coefs[5] == pytest.approx(-0.4, abs=0.15)
    assert fit.sigma2 == pytest.approx(1.0, abs=0.2) and fit.bic > fit.aic
    path = collect(seasonal.forecast_seasonal(df, 14))
    assert len(path) == 14 and path.ts[0] == pdf.ts.max() + pd.Timedelta(days=1) and path.pred.notna().all()


def test_normal_and_t_tails(spark):
    df = spark.createDataFrame([(z,) for z in (-3.0, -1.0, 0.0, 0.5, 2.0)], "z double")
    for r in df.select("z", stats.normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=5e-7)
    back = df.select("z", stats.normal_ppf(stats.normal_cdf(F.col("z"))).alias("b")).collect()
    assert all(r.b == pytest.approx(r.z, abs=1e-4) for r in back)
    # Tabulated values of the t distribution.
    t = spark.createDataFrame([(2.228, 10.0, 0.05), (1.96, 1e6, 0.05), (12.706, 1.0, 0.05), (0.0, 5.0, 1.0)], "t double, d double, p double")
    assert all(r[0] == pytest.approx(r[1], abs=2e-4) for r in t.select(stats.two_sided_t_p("t", "d"), "p").collect())


def test_diebold_mariano_equals_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=120, freq="h"), "d": rng.normal(-0.4, 1, 120)})
    got = evaluate.diebold_mariano(spark.createDataFrame(pdf)).head()
    d = pdf.d.to_numpy()
    var = (np.var(d, ddof=1) + 2 * np.cov(d[1:], d[:-1])[0, 1]) / len(d)
    assert got.dm_stat == pytest.approx(d.mean() / math.sqrt(max(var, 1e-12)))
    assert got.reject == (got.p_value < 0.05)


def test_calibration_curve_equals_numpy(spark):
    rng = np.random.default_rng(4)
    res = np.concatenate([rng.normal(size=150), np.zeros(80)])
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "residual": res}))
    for r in evaluate.calibration_curve(df).collect():
        half = (1 - r.nominal) / 2
        lo, hi = np.quantile(res, half), np.quantile(res, 1 - half)
        assert r.empirical == pytest.approx(((res >= lo) & (res <= hi)).mean())
    assert evaluate.at_level(evaluate.calibration_curve(df)).head().nominal == 0.8


def test_trees_leaf_quantiles_and_importance(spark):
    pdf = demand(500, series=("a", "b"))
    pdf["demand_gw"] = 50 + 10 * np.sin(2 * np.pi * pdf.ts.dt.hour / 24) + np.random.default_rng(5).normal(size=len(pdf))
    rows = build_features(spark.createDataFrame(pdf)).persist()
    names = ["hour", "demand_lag_24h"]
    model = models.fit_trees(rows, names, models.TreeParams(rounds=5, depth=4, step=0.3))
    err = models.score_trees(model, rows).select(F.avg(F.abs(F.col("prediction") - F.col("demand_gw")))).head()[0]
    assert err < 3
    assert {r.feature for r in models.feature_importance(model).collect()} == {"hour", "demand_lag_24h", "_level", "_spread"}
    scored = models.permutation_importance(model, rows, names).collect()
    assert {r.rows for r in scored} == {rows.count()}
    for few in (1, 2):
        assert {r.rows for r in models.permutation_importance(model, rows.limit(few), names).collect()} == {few}
    perm = {r.feature: r.importance for r in scored}
    assert set(perm) == set(names) and max(perm.values()) > 1
    fit = models.fit_leaf_quantiles(rows, names, depth=3)
    inside = fit.bounds(rows).select(F.avg(F.col("demand_gw").between(F.col("lower"), F.col("upper")).cast("double"))).head()[0]
    assert 0.75 < inside < 0.85 and fit.leaves.count() <= 8


def test_attribution_sums_to_centred_prediction(spark):
    pdf = demand(200).rename(columns={"temperature_f": "x"})
    rows = models.attribution_long(spark.createDataFrame(pdf), {"x": 2.0, "demand_gw": -1.0}, 150).toPandas()
    tail = pdf.tail(150)
    total = 2 * (tail.x - tail.x.mean()) - (tail.demand_gw - tail.demand_gw.mean())
    np.testing.assert_allclose(rows.groupby("ts")["attribution"].sum(), total, atol=1e-9)


def test_gate(spark):
    new = spark.createDataFrame([("a", 1.59, "2024-05-01"), ("b", 1.60, "2024-05-01"), ("c", 3.0, "2024-05-01")], "series_id string, new_mape double, new_end_date string").withColumn("new_end_date", F.to_date("new_end_date"))
    state = spark.createDataFrame([("b", 1.52, "2024-01-01"), ("c", 2.9, "2024-01-01")], "series_id string, baseline_mape double, last_end_date string").withColumn("last_end_date", F.to_date("last_end_date"))
    decided = gate.decide(new, state)
    assert {r.series_id: r.outcome for r in decided.collect()} == {"a": "PROMOTED", "b": "REJECTED", "c": "PROMOTED"}
    after = {r.series_id: r.baseline_mape for r in gate.next_state(decided, state, "2024-06-01").collect()}
    assert after == {"a": 1.59, "b": 1.52, "c": 3.0}
    fixed = {r.series_id: r.baseline_mape for r in gate.next_state(decided, state, "2024-06-01", fixed_baseline=True).collect()}
    assert fixed == {"a": 1.52, "b": 1.52, "c": 2.9}


@pytest.mark.parametrize("enrich", [True, False])
def test_retrain_needs_weather_on_new_rows(spark, enrich):
    pdf = demand(400)
    existing = spark.createDataFrame(pdf.head(300))
    new = spark.createDataFrame(pdf.tail(110)).drop("temperature_f")
    state = spark.createDataFrame([("a", 1000.0)], "series_id string, baseline_mape double").withColumn("last_end_date", F.lit(None).cast("date"))
    seen = []

    def fit_and_score(train, test):
        seen.append(test.count())
        return test.select("series_id", F.col("demand_gw").alias("actual"), F.lit(100.0).alias("pred"))

    cut = str(pdf.ts[290])
    out = gate.retrain(existing, new, state, cut, fit_and_score, enrich=enrich).head()
    assert out.outcome == "PROMOTED" and out.data_rows == 400
    assert seen == [110 if enrich else 10]
    assert "temperature_f" in fill_temperature(new).columns


def test_widen_keeps_groups_without_calibration(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], "series_id string, lower double, upper double")
    offsets = spark.createDataFrame([("a", 0.5)], "series_id string, conformal_offset double")
    assert {r.series_id: (r.lower, r.upper) for r in intervals.widen(rows, offsets).collect()} == {"a": (0.5, 2.5), "b": (0.5, 2.5)}
    assert intervals.widen(rows, offsets.where("false")).where("lower = 1").count() == 2

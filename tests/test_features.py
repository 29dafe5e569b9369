import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourloom.catalog.core import rounded
from hourloom.functions.weather import degree_columns, synthetic_temperature
from hourloom.operators import quality, split
from hourloom.plans.features import build_features, feature_names
from hourloom.session import configure

from .helpers import collect, demand, hours


@pytest.fixture(scope="module")
def raw():
    return demand(300)


@pytest.fixture(scope="module")
def features(spark, raw):
    return collect(build_features(spark.createDataFrame(raw)))


def test_columns_and_rows(features, raw):
    assert len(feature_names()) == 32 and len(feature_names("backtest")) == 24
    assert set(feature_names()) <= set(features.columns)
    assert not features[feature_names()].isnull().any().any()
    assert len(features) == len(raw) - 168


def test_values_equal_pandas(features, raw):
    s = raw.set_index("ts")["demand_gw"]
    for k in (1, 24, 168):
        np.testing.assert_allclose(features[f"demand_lag_{k}h"], s.shift(k).dropna().tail(len(features)))
    past = s.shift(1)
    np.testing.assert_allclose(features["demand_roll_mean_24h"], past.rolling(24).mean().tail(len(features)))
    np.testing.assert_allclose(features["demand_roll_std_24h"], past.rolling(24).std().tail(len(features)))
    np.testing.assert_allclose(features["demand_roll_mean_168h"], past.rolling(168).mean().tail(len(features)))
    ts = features["ts"]
    assert list(features["dayofweek"]) == list(ts.dt.dayofweek)
    assert list(features["weekofyear"]) == list(ts.dt.isocalendar().week)
    np.testing.assert_allclose(features["dow_sin"], np.sin(2 * np.pi * ts.dt.dayofweek / 7), atol=1e-12)
    assert features[["temp_cooling", "temp_heating"]].min().min() >= 0
    assert set(features["is_weekend"]) <= {0, 1}


def test_rolling_needs_every_value(spark, raw):
    df = spark.createDataFrame(raw).withColumn("demand_gw", F.when(F.hour("ts") + F.day("ts") != 13, F.col("demand_gw")))
    got = collect(build_features(df, keep_incomplete=True))
    past = got["demand_gw"].shift(1)
    for name, want in (("mean_24h", past.rolling(24).mean()), ("std_24h", past.rolling(24).std()), ("mean_168h", past.rolling(168).mean())):
        np.testing.assert_allclose(got[f"demand_roll_{name}"], want)


def test_no_frame_is_longer_than_a_day(spark, raw):
    plan = build_features(spark.createDataFrame(raw))._jdf.queryExecution().optimizedPlan().toString()
    frames = [int(n) for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), -1\)", plan)]
    assert frames and max(frames) <= 24


def test_weekly_mean_across_buckets_with_nulls(spark):
    raw = demand(5000, start="2023-01-01", series=("a", "b"))
    raw.loc[raw.index % 997 == 5, "demand_gw"] = None
    df = spark.createDataFrame(raw).withColumn("demand_gw", F.nanvl("demand_gw", F.lit(None)))
    full, served = collect(build_features(df, keep_incomplete=True)), collect(build_features(df, policy="serve"))
    for s in ("a", "b"):
        past = raw[raw.series_id == s]["demand_gw"].shift(1)
        for name, n in (("mean_24h", 24), ("std_24h", 24), ("mean_168h", 168)):
            how = name.split("_")[0]
            column = f"demand_roll_{name}"
            want = getattr(past.rolling(n), how)()
            np.testing.assert_allclose(full[full.series_id == s][column].astype(float), want, rtol=1e-9)
            want = getattr(past.rolling(n, min_periods=1), how)().fillna(0.0)
            np.testing.assert_allclose(served[served.series_id == s][column], want, rtol=1e-9)


def test_rounding_equals_decimals(spark):
    rng = np.random.default_rng(3)
    ties = rng.integers(-10**10, 10**10, 2000) / 2e6
    x = np.concatenate([
        rng.uniform(-500, 500, 2000), ties, ties + 1e-9, 10.0 ** rng.uniform(-20, 20, 2000),
        [0.0, -0.0, -1e-9, 4.9e-7, 5e-7, -5e-7, np.nan, np.inf, -np.inf, 1e300, 999999.9999995, 1e6],
    ])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    both = df.select(F.round("x", 6).cast("string").alias("want"), rounded(F.col("x")).cast("string").alias("got"))
    assert both.where("not (want <=> got)").collect() == []


def test_wide_projections_stay_compiled(spark):
    assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_growth_rises(spark):
    out = collect(build_features(spark.createDataFrame(demand(2000))))["data_center_load_gw"]
    assert out[len(out) // 2 :].mean() > out[: len(out) // 2].mean()


def test_serving_policy_equals_loop(spark, raw):
    got = collect(build_features(spark.createDataFrame(raw), policy="serve", holidays="serve"))
    y = raw["demand_gw"].to_numpy()
    for i in (0, 1, 5, 30, 170):
        past = y[:i]
        assert got["demand_lag_24h"][i] == y[max(i - 24, 0)]
        want = past[-24:].mean() if i else 0.0
        assert got["demand_roll_mean_24h"][i] == pytest.approx(want)
        assert got["demand_roll_std_24h"][i] == pytest.approx(past[-24:].std(ddof=1) if i > 1 else 0.0)


def test_by_row_ignores_missing_hours(spark, raw):
    holes = raw.drop(index=[50, 51, 120]).reset_index(drop=True)
    got = collect(build_features(spark.createDataFrame(holes), by_row=True))
    np.testing.assert_allclose(got["demand_lag_1h"], holes["demand_gw"].shift(1).tail(len(got)))


def test_no_temperature_and_null_temperature(spark, raw):
    plain = build_features(spark.createDataFrame(raw.drop(columns="temperature_f")))
    assert plain.select(F.max("temp_sq")).head()[0] == 0.0
    null = spark.sql("select cast(null as double) t").select(*[c.alias(n) for n, c in degree_columns(F.col("t")).items()])
    assert null.head() == (None, None, None)


def test_split_and_calibration(spark, raw):
    df = spark.createDataFrame(raw)
    train, test = split.temporal_split(df, "2023-01-10")
    assert train.count() + test.count() == len(raw)
    counts = {r[0]: r[1] for r in split.label_splits(df, "2023-01-10", 100).groupBy("split").count().collect()}
    assert counts["calibration"] == 100 and counts["train"] == 9 * 24 - 100
    assert split.feature_columns(build_features(df)) == feature_names()


def test_synthetic_temperature(spark):
    axis = pd.DataFrame({"ts": hours("2022-01-01", 26280)})
    df = spark.createDataFrame(axis).withColumn("t", synthetic_temperature(F.col("ts")))
    out = df.agg(F.min("t"), F.max("t"), F.count_if(F.isnull("t")), F.avg(F.when(F.month("ts") == 1, F.col("t"))),
                 F.avg(F.when(F.month("ts") == 7, F.col("t"))), F.avg(F.when(F.hour("ts") == 3, F.col("t"))),
                 F.avg(F.when(F.hour("ts") == 12, F.col("t")))).head()
    assert out[0] > -20 and out[1] < 115 and out[2] == 0 and out[3] < out[4] and out[5] < out[6]


def test_quality_reports(spark, raw):
    df = spark.createDataFrame(raw.drop(index=[10]))
    assert quality.spacing_report(df).head().violations == 1
    ranges = {r.rule: r.violations for r in quality.range_report(df, {"demand_gw": (0, 100), "temperature_f": (None, 200)}).collect()}
    assert ranges == {"demand_gw": int((raw.drop(index=[10])["demand_gw"] > 100).sum()), "temperature_f": 0}

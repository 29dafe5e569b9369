import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourloom.plans import backtest, forecast
from hourloom.plans.forecast import LinearModel

from .helpers import collect, demand

MODEL = LinearModel(intercept=5.0, lags={1: 0.4, 24: 0.3, 168: 0.2}, mean_24h=0.05)


def step(history):
    at = lambda k: history[max(len(history) - k, 0)]
    return 5.0 + 0.4 * at(1) + 0.3 * at(24) + 0.2 * at(168) + 0.05 * np.mean(history[-24:])


def roll(history, n):
    history = list(history)
    for _ in range(n):
        history.append(step(history))
    return history[-n:]


def requests(spark, hours=30, start=None, series="a"):
    return spark.createDataFrame([(1, series, hours, start)], "request_id long, series_id string, hours int, start_ts timestamp")


def test_recursion_equals_loop(spark):
    pdf = demand(300, temperature=False)
    df = spark.createDataFrame(pdf)
    anchors = df.groupBy("series_id").agg(F.max("ts").alias("anchor_ts"))
    out = forecast.recursive_linear(forecast.resolve_requests(requests(spark), anchors), forecast.seed_arrays(df), MODEL)
    got = out.toPandas().sort_values("step")
    assert got["ts"].iloc[0] == pdf["ts"].max() + pd.Timedelta(hours=1)
    np.testing.assert_allclose(got["pred"], roll(pdf["demand_gw"].tail(200), 30))


def test_step_loop_equals_fold(spark):
    df = spark.createDataFrame(demand(220, temperature=False))
    anchors = df.groupBy("series_id").agg(F.max("ts").alias("anchor_ts"))
    resolved = forecast.resolve_requests(requests(spark, 8), anchors)
    seeds = forecast.seed_arrays(df)
    score = lambda d: d.withColumn("prediction", MODEL.step(F.col("_history"), F.col("_ts")))
    looped = forecast.recursive_model(resolved, seeds, lambda d: d, score, segment=3).toPandas().sort_values("step")
    folded = forecast.recursive_linear(resolved, seeds, MODEL).toPandas().sort_values("step")
    np.testing.assert_allclose(looped["pred"], folded["pred"])


@pytest.mark.parametrize("gap", [0, 5, 230])
def test_bridge(spark, gap):
    pdf = demand(250, temperature=False)
    seeds = forecast.seed_arrays(spark.createDataFrame(pdf))
    newer = seeds.select("series_id", (F.col("last_ts") + F.make_dt_interval(hours=F.lit(gap))).alias("anchor_ts"))
    got = forecast.bridge_seeds(seeds, newer).head().seed
    seed = list(pdf["demand_gw"].tail(200))
    want = seed[gap:] + [np.mean(seed[-24:])] * gap if gap else seed
    np.testing.assert_allclose(got, want)


def test_seed_fallbacks(spark):
    df = spark.createDataFrame(demand(50, temperature=False))
    wanted = spark.createDataFrame([("a",), ("new",)], "series_id string")
    fresh_short = forecast.seed_arrays(spark.createDataFrame(demand(10, start="2024-01-01", temperature=False)))
    rows = {r.series_id: r for r in forecast.choose_seed(wanted, forecast.seed_arrays(df), fresh_short).collect()}
    assert len(rows["a"].seed) == 50 and rows["new"].seed == [50.0] * 200
    fresh = forecast.seed_arrays(spark.createDataFrame(demand(30, start="2024-01-01", temperature=False)))
    rows = {r.series_id: r for r in forecast.choose_seed(wanted, forecast.seed_arrays(df), fresh).collect()}
    assert len(rows["a"].seed) == 30


def test_filled_horizon_features(spark):
    pdf = demand(220, temperature=False)
    df = spark.createDataFrame(pdf)
    out = forecast.filled_horizon(requests(spark, 3, pd.Timestamp("2024-01-01").to_pydatetime()), forecast.seed_arrays(df), "zero").toPandas().sort_values("step")
    seed = list(pdf["demand_gw"].tail(200))
    past = seed + [0.0, 0.0]
    last = out.iloc[2]
    assert last["demand_lag_1h"] == 0.0 and last["demand_lag_24h"] == past[-24]
    assert last["demand_roll_std_24h"] == pytest.approx(np.std(past[-24:], ddof=1))


def test_recursive_window_and_reanchoring(spark):
    pdf = demand(24 * 4 + 168, temperature=False)
    df = spark.createDataFrame(pdf)
    y = list(pdf["demand_gw"])
    n = 24 * 4
    got = collect(backtest.recursive_window(df, 4, MODEL))
    np.testing.assert_allclose(got["pred"], roll(y[:-n], n))
    again = collect(backtest.recursive_window(df, 4, MODEL, reanchor_hours=36))
    start = len(y) - n
    want = roll(y[:start], 36) + roll(y[: start + 36], 36) + roll(y[: start + 72], 24)
    np.testing.assert_allclose(again["pred"], want)
    assert backtest.recursive_window(df, 5, MODEL).count() == 0
    assert backtest.clamp_window(500) == 90 and backtest.clamp_window(0) == 1


def test_folds_equal_loop(spark):
    pdf = demand(24 * 200, temperature=False).iloc[::24].reset_index(drop=True)
    pdf = pdf.drop(index=range(120, 145)).reset_index(drop=True)
    df = spark.createDataFrame(pdf)
    args = dict(train_months=2, test_days=20, min_train=30, min_test=10)
    got = backtest.fold_table(df, **args).toPandas().sort_values("fold")
    start, end = pdf.ts.min(), pdf.ts.max()
    train_end = start + pd.DateOffset(months=2)
    want = []
    while train_end + pd.Timedelta(days=20) <= end:
        stop = train_end + pd.Timedelta(days=20)
        a, b = (pdf.ts < train_end).sum(), ((pdf.ts >= train_end) & (pdf.ts < stop)).sum()
        if a < 30 or b < 10:
            break
        want.append((train_end, stop, a, b))
        train_end = stop
    assert [tuple(r) for r in got[["test_start", "test_end", "n_train", "n_test"]].itertuples(index=False)] == want
    assert len(want) >= 1


def test_precomputed_bands(spark):
    df = spark.createDataFrame([("a", pd.Timestamp("2024-01-01").to_pydatetime(), 1.0, 2.0, None), ("a", pd.Timestamp("2024-01-01 01:00").to_pydatetime(), 1.0, 3.0, 2.5)],
                               "series_id string, ts timestamp, actual double, pred double, lower_gw double")
    rows = forecast.precomputed(df, 2).orderBy("ts").collect()
    assert [r.lower_gw for r in rows] == [pytest.approx(1.38), 2.5] and rows[1].upper_gw == pytest.approx(3.61)


def test_each_request_gets_its_own_hours(spark):
    df = spark.createDataFrame(demand(220, series=("a", "b"), temperature=False))
    asked = spark.createDataFrame([("x", "a", 48), ("y", "b", 3), ("z", "unknown", 5)], "request_id string, series_id string, hours int").withColumn(
        "start_ts", F.lit("2023-02-01").cast("timestamp"))
    score = lambda d: d.withColumn("prediction", MODEL.step(F.col("_history"), F.col("_ts")))
    got = forecast.recursive_model(asked, forecast.seed_arrays(df), lambda d: d, score, segment=4)
    counts = {r["request_id"]: r["count"] for r in got.groupBy("request_id").count().collect()}
    assert counts == {"x": 48, "y": 3, "z": 5}
    served = forecast.serve_requests(asked, df, df.groupBy("series_id").agg(F.max("ts").alias("anchor_ts")), MODEL)
    assert {r["request_id"]: r["count"] for r in served.groupBy("request_id").count().collect()} == counts


def test_window_reads_the_longest_lag(spark):
    pdf = demand(960, temperature=False)
    pdf["demand_gw"] = np.arange(960.0)
    got = collect(backtest.recursive_window(spark.createDataFrame(pdf), 1, forecast.LinearModel(lags={336: 1.0})))
    np.testing.assert_allclose(got["pred"], np.arange(960 - 24 - 336, 960 - 336))


def test_linear_folds_without_earlier_rows(spark):
    pdf = demand(24 * 200, temperature=False).iloc[::24].reset_index(drop=True)
    pdf["x"] = np.where(np.arange(200) < 80, np.nan, 1.0 * np.arange(200))
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    got = backtest.walk_forward_linear(df, ["x"], train_months=2, test_days=20, min_train=30, min_test=10)
    assert 0 < got.count() < backtest.fold_table(df, train_months=2, test_days=20, min_train=30, min_test=10).count()


def test_fold_fits_share_rows_and_levels(spark):
    """Late, short and ending series; many shuffle partitions must not become many tasks of every fit."""
    start = pd.Timestamp("2023-01-01")
    days = {"a": (0, 120), "b": (17, 120), "c": (0, 62), "d": (95, 100)}
    pdf = pd.concat([
        pd.DataFrame({"series_id": s, "ts": pd.date_range(start + pd.Timedelta(days=lo), periods=hi - lo, freq="D"),
                      "actual": np.random.default_rng(hi + lo).normal(100, 20, hi - lo)})
        for s, (lo, hi) in days.items()])
    geometry = {"train_months": 1, "test_days": 10, "min_train": 5, "min_test": 1}
    seen = []

    def fit(train, known):
        seen.append((train.rdd.getNumPartitions(), train.select("series_id", "segment", "ts", "actual").toPandas(),
                     {r["series_id"]: (r["_level"], r["_spread"]) for r in known[0].collect()}, known[1]))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "41")
        df = spark.createDataFrame(pdf).repartition(41)
        out = backtest.walk_forward_model(
            df, fit, lambda _, test: test.withColumn("pred", F.lit(100.0)), levels="actual", **geometry).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    folds = backtest.fold_table(spark.createDataFrame(pdf), **geometry).toPandas()
    assert len(out) == len(folds) and sorted(zip(out.series_id, out.fold)) == sorted(zip(folds.series_id, folds.fold))
    assert len(seen) == folds.segment.nunique()
    by_fold = {len(rows): (tasks, rows, levels, overall) for tasks, rows, levels, overall in seen}
    for _, part in folds.groupby("segment"):
        want = pdf[pdf.series_id.isin(part.series_id) & (pdf.ts < part.test_start.min())]
        tasks, rows, levels, overall = by_fold[len(want)]
        assert tasks <= backtest.FIT_TASKS
        assert sorted(zip(rows.series_id, rows.ts)) == sorted(zip(want.series_id, want.ts))
        assert overall == pytest.approx((want.actual.mean(), want.actual.std()))
        assert set(levels) == set(want.series_id)
        for s, mine in want.groupby("series_id"):
            assert levels[s] == pytest.approx((mine.actual.mean(), mine.actual.std()))

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourloom.operators import clean, metrics, rank
from hourloom.operators.buckets import drop_halo, halo_window, with_halo, with_neighbours, with_positions
from hourloom.operators.quantile import quantiles, ranked_values

from .helpers import collect, demand, sparse

@pytest.mark.parametrize("width", [24, 50, 4096])
def test_halo_equals_whole_window(spark, width):
    df = spark.createDataFrame(demand(200, series=("a", "b")))
    cols = lambda w: {"lag": F.lag("demand_gw", 24).over(w), "mean": F.avg("demand_gw").over(w.rowsBetween(-24, -1))}
    got = collect(drop_halo(with_halo(df, 24, width=width).withColumns(cols(halo_window()))))
    want = collect(df.withColumns(cols(Window.partitionBy("series_id").orderBy("ts"))))
    pd.testing.assert_frame_equal(got[want.columns], want)


@pytest.mark.parametrize("width", [5, 48, 4096])
def test_neighbours_cross_empty_buckets(spark, width):
    pdf = sparse(keep=0.05)
    df = spark.createDataFrame(pdf)
    got = collect(with_neighbours(df, ["demand_gw"], width=width).select(
        "series_id", "ts", F.col("_prev.demand_gw").alias("p"), F.col("_next.ts").alias("n")))
    by = pdf.sort_values(["series_id", "ts"]).groupby("series_id")
    np.testing.assert_allclose(got["p"], by["demand_gw"].shift(1).loc[pdf.sort_values(["series_id", "ts"]).index])
    assert list(got["n"].fillna(pd.Timestamp(0))) == list(by["ts"].shift(-1).loc[pdf.sort_values(["series_id", "ts"]).index].fillna(pd.Timestamp(0)))


@pytest.mark.parametrize("width", [7, 4096])
def test_positions(spark, width):
    pdf = sparse()
    got = collect(with_positions(spark.createDataFrame(pdf), width=width))
    by = pdf.sort_values(["series_id", "ts"]).groupby("series_id")
    assert list(got["_pos"]) == list(by.cumcount().sort_index())
    assert list(got["_n"]) == list(by["ts"].transform("count").sort_index())


def test_rows_share_one_scan(spark, tmp_path):
    spark.createDataFrame(sparse()).write.parquet(str(tmp_path / "t"))
    df = with_positions(spark.read.parquet(str(tmp_path / "t")))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_gap_fill_equals_pandas_time_interpolation(spark):
    pdf = sparse(keep=0.2)
    got = collect(clean.gap_fill(spark.createDataFrame(pdf)))
    for s, part in pdf.groupby("series_id"):
        idx = pd.date_range(part.ts.min(), part.ts.max(), freq="h")
        want = part.set_index("ts")["demand_gw"].reindex(idx).interpolate(method="time")
        np.testing.assert_allclose(got[got.series_id == s]["demand_gw"], want)


def test_interpolate_keeps_leading_null_and_carries_trailing(spark):
    rows = [("a", i, v) for i, v in enumerate([None, 1.0, None, 3.0, None, None])]
    df = spark.createDataFrame(rows, "series_id string, i int, demand_gw double")
    df = df.withColumn("ts", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("i")))
    got = collect(clean.interpolate_time(df))["demand_gw"]
    assert np.isnan(got[0]) and list(got[1:]) == [1.0, 2.0, 3.0, 3.0, 3.0]


def test_dedup_and_bad_values(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01T05", "1500", 2), ("a", "2024-01-01T05", "900", 1), ("a", "2024-01-01T06", "n/a", 3), ("a", "junk", "1", 4)],
        "series_id string, period string, value string, seq int")
    typed = df.select("series_id", clean.parse_period(F.col("period")).alias("ts"), clean.mega_to_giga(F.col("value")).alias("v"), "seq")
    assert typed.where("v is null").count() == 1 and typed.where("ts is null").count() == 1
    first = clean.dedup_first(typed.dropna(), "seq").collect()
    assert [(r.v, r.seq) for r in first] == [(0.9, 1)]
    assert clean.dedup_last(typed.dropna(), "seq").collect()[0].v == 1.5


def _skewed(seed=3):
    rng = np.random.default_rng(seed)
    hot = np.concatenate([np.full(700, 5.0), rng.normal(50, 20, 900)])
    cold = rng.normal(0, 1, 7)
    return pd.DataFrame({"g": ["hot"] * len(hot) + ["cold"] * len(cold) + ["one"], "v": np.concatenate([hot, cold, [4.0]])})


def test_quantiles_equal_numpy_with_ties_and_skew(spark):
    pdf = _skewed()
    levels = [0.0, 0.1, 0.333, 0.5, 0.8, 0.999, 1.0]
    got = quantiles(spark.createDataFrame(pdf), ["g"], "v", levels).toPandas()
    assert len(got) == 3 * len(levels)
    for _, r in got.iterrows():
        v = pdf[pdf.g == r.g]["v"].to_numpy()
        q = np.quantile(v, r.level)
        assert r.value == pytest.approx(q, abs=1e-9)
        assert r.n == len(v)
        if r.level in (0.5, 1.0):
            assert (r.n_below, r.n_upto) == ((v < q).sum(), (v <= q).sum())


def test_ranks_cover_every_row(spark):
    pdf = _skewed()
    ranked = ranked_values(spark.createDataFrame(pdf), ["g"], "v").toPandas()
    for g, part in ranked.groupby("g"):
        part = part.sort_values("_value")
        assert list(part["_before"]) == list(part["_count"].cumsum() - part["_count"])
        assert part["_count"].sum() == (pdf.g == g).sum()


def test_tail_and_head_both_ways(spark):
    pdf = demand(1500, temperature=False)
    df = spark.createDataFrame(pdf)
    for n in (200, 1200):
        assert list(collect(rank.tail(df, n))["ts"]) == list(pdf["ts"].tail(n))
        assert list(collect(rank.head(df, n))["ts"]) == list(pdf["ts"].head(n))
    assert rank.all_but_tail(df, 1200).count() == 300


def test_ties_are_cut_alike_for_any_number(spark):
    pdf = demand(1500, temperature=False)
    pdf["ts"] = pdf["ts"].iloc[np.arange(1500) // 2 * 2].to_numpy()
    df = spark.createDataFrame(pdf)
    order = pdf.sort_values(["ts", "demand_gw"])
    for n in (999, 1001):
        assert sorted(collect(rank.tail(df, n))["demand_gw"]) == sorted(order["demand_gw"].tail(n))
        assert sorted(collect(rank.head(df, n))["demand_gw"]) == sorted(order["demand_gw"].head(n))


def test_histogram_equals_numpy(spark):
    pdf = demand(500, temperature=False)
    got = metrics.histogram(spark.createDataFrame(pdf), "demand_gw", 60).toPandas().set_index("bin")["n"]
    want, _ = np.histogram(pdf["demand_gw"], bins=60)
    assert list(got.reindex(range(60), fill_value=0)) == list(want)
    flat = spark.createDataFrame([("a", 1.0)] * 3, "series_id string, demand_gw double")
    assert metrics.histogram(flat, "demand_gw", 10).select("bin", "n").collect() == [(0, 3)]

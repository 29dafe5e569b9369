import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourloom.operators import joins
from hourloom.plans.pipeline import clean_demand
from hourloom.sources import pages, registry, tables
from hourloom.streaming import incremental as inc

from .helpers import demand


def test_load_pages(spark, tmp_path):
    page = lambda rows: json.dumps({"series_id": "a", "response": {"total": "3", "data": rows}})
    (tmp_path / "p.json").write_text("\n".join([
        page([{"period": "2024-01-01T00", "value": "1000"}, {"period": "2024-01-01T01", "value": None}]),
        page([{"period": "2024-01-01 02:00:00+00:00", "value": 3000}]),
        page([]),
    ]))
    rows = pages.read_load_pages(spark, str(tmp_path))
    assert rows.count() == 3
    stored = spark.createDataFrame([("a", pd.Timestamp("2024-01-05").to_pydatetime(), 9.0)], "series_id string, ts timestamp, demand_gw double")
    since = F.lit("2024-01-01").cast("timestamp")
    got = pages.load_increment(rows, stored, since).collect()
    assert [(str(r.ts), r.demand_gw) for r in got] == [("2024-01-01 02:00:00", 3.0)]
    assert pages.load_increment(None, stored, since).head().demand_gw == 9.0


def test_weather_pages_and_union(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [30.5, None]}}))
    rows = pages.read_weather_pages(spark, str(tmp_path))
    assert [r.temperature_f for r in rows.orderBy("ts").collect()] == [30.5, None]
    newer = rows.withColumn("temperature_f", F.lit(40.0))
    assert {r.temperature_f for r in joins.union_prefer_last(rows, newer).collect()} == {40.0}
    clamped = spark.range(-1, 30).select(pages.clamp_days(F.col("id")).alias("d")).agg(F.min("d"), F.max("d")).head()
    assert tuple(clamped) == (1, 16)


def test_clean_demand_end_to_end(spark):
    raw = spark.createDataFrame(
        [("a", "2024-01-01T00", "1000", 1), ("a", "2024-01-01T00", "7", 2), ("a", "2024-01-01T02", "3000", 3), ("a", "2024-01-01T03", "x", 4)],
        "series_id string, period string, value string, seq int")
    temp = spark.createDataFrame([(pd.Timestamp("2024-01-01 00:00").to_pydatetime(), 33.0)], "ts timestamp, temperature_f double")
    rows = clean_demand(raw, temp).orderBy("ts").collect()
    assert [r.demand_gw for r in rows] == [1.0, 2.0, 3.0]
    assert rows[0].temperature_f == 33.0 and rows[1].temperature_f is not None


def test_tables_and_registry(spark, tmp_path):
    df = spark.createDataFrame(demand(30, series=("a", "b")))
    tables.write_table(df, str(tmp_path / "t"))
    assert tables.read_demand(spark, str(tmp_path / "t")).count() == 60
    for mape in (2.0, 1.0):
        row = spark.createDataFrame([("m", mape)], "name string, mape double")
        registry.log_runs(registry.run_records(
            row, F.col("name"), "x", F.lit(f"2024-01-0{int(mape)} 00:00:00"), F.create_map(F.lit("feature_count"), F.lit("32")),
            F.create_map(F.lit("mape"), F.col("mape")), F.create_map(F.lit("model"), F.lit("trees"))), str(tmp_path / "r"))
    runs = registry.load_runs(spark, str(tmp_path / "r"))
    assert [r["rank"] for r in registry.leaderboard(runs).orderBy("score").collect()] == [1, 2]
    now = registry.current_models(runs).head()
    assert now.mape == 2.0 and now.feature_count == 32
    with pytest.raises(FileNotFoundError):
        registry.load_model(spark, str(tmp_path / "none"))


def test_merge_sink_survives_replay(spark, tmp_path):
    sink = inc.merge_sink(str(tmp_path / "m"), tie_break="seq")
    batch = lambda rows: spark.createDataFrame(rows, "series_id string, ts timestamp, v double, seq int")
    t = pd.Timestamp("2024-01-01").to_pydatetime()
    sink(batch([("a", t, 1.0, 2), ("a", t, 0.5, 1)]), 0)
    second = batch([("a", t, 9.0, 3), ("b", t, 2.0, 4)])
    sink(second, 1)
    sink(second, 1)
    got = sorted((r.series_id, r.v) for r in spark.read.parquet(str(tmp_path / "m")).collect())
    assert got == [("a", 0.5), ("b", 2.0)]


@pytest.mark.parametrize("order", [lambda i: i // 20, lambda i: i % 3, lambda i: 2 - i // 20])
def test_lags_are_right_for_any_order_of_files(spark, tmp_path, order):
    pdf = demand(60, temperature=False)
    src = tmp_path / "src"
    for k in range(3):
        part = pdf[[order(i) == k for i in range(60)]]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("series_id string, ts timestamp, demand_gw double").option("maxFilesPerTrigger", 1).parquet(str(src))
    values, out = str(tmp_path / "values"), str(tmp_path / "out")
    inc.run_available(stream, inc.lag_sink(values, out), checkpoint=str(tmp_path / "cp"))
    got = inc.latest_versions(spark, out).toPandas().sort_values("ts")
    assert len(got) == 60 and list(got["lag_1"].iloc[1:]) == list(pdf["demand_gw"].iloc[:-1])
    assert list(got["lag_24"].dropna()) == list(pdf["demand_gw"].iloc[:36])

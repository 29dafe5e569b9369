import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.plans import backtest, features as feats, forecast, forest, models
from hourloom.session import stored

from .helpers import collect, demand

PARAMS = models.TreeParams(rounds=5, depth=4, step=0.3)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame(demand(420, series=("a", "b"), seed=4))
    table = stored(feats.build_features(rows), "features")
    return rows, table, models.fit_trees(table, feats.feature_names(), PARAMS)


def test_expression_equals_the_model(fitted):
    _, table, model = fitted
    flat = forest.Forest.of(model.model)
    levelled = models.with_levels(model.levels, model.overall, table)
    both = models.score_trees(model, levelled).withColumn("other", flat.predict({n: F.col(n) for n in flat.inputs}))
    got = collect(both.select("series_id", "ts", "prediction", "other"))
    assert len(got) == 2 * (420 - 168) and got.prediction.nunique() > 20
    assert np.allclose(got.prediction, got.other, rtol=0, atol=1e-9)


def test_recursion_equals_the_step_loop_without_a_job_per_step(spark, fitted):
    rows, _, model = fitted
    served = forest.ForestModel.of(model)
    requests = rows.groupBy("series_id").agg(F.max("ts").alias("anchor_ts")).select(
        F.concat(F.lit("r-"), "series_id").alias("request_id"), "series_id", F.lit(7).alias("hours"), (F.col("anchor_ts") + F.expr("INTERVAL 1 HOUR")).alias("start_ts"))
    seeds = forecast.seed_arrays(rows)
    spark.sparkContext.setJobGroup("fold", "one plan")
    plan = forecast.recursive_linear(requests, seeds, served)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("fold")  # nothing ran to build it
    got = collect(plan, by=("request_id", "step"))
    loop = collect(forecast.recursive_model(
        models.with_levels(model.levels, model.overall, requests), seeds, forecast.serving_features, lambda d: models.score_trees(model, d)), by=("request_id", "step"))
    assert len(got) == 14 and list(got.ts) == list(loop.ts)
    assert np.allclose(got.pred, loop.pred, rtol=0, atol=1e-9)


def test_requests_and_windows_take_a_fitted_model(spark, fitted):
    rows, _, model = fitted
    served = forest.ForestModel.of(model)
    anchors = rows.groupBy("series_id").agg(F.max("ts").alias("anchor_ts"))
    requests = spark.createDataFrame([("x", "a", 5, None), ("y", "unknown", 3, None)], "request_id string, series_id string, hours int, start_ts timestamp").withColumn(
        "start_ts", F.coalesce("start_ts", F.lit("2024-02-10 06:00:00").cast("timestamp")))
    points = collect(forecast.serve_requests(requests, rows, anchors, served), by=("request_id", "step"))
    assert list(points.request_id) == ["x"] * 5 + ["y"] * 3 and points.notna().all().all()
    assert ((points.lower_gw < points.pred) & (points.pred < points.upper_gw)).all()
    window = collect(backtest.recursive_window(rows, 3, served, reanchor_hours=24))
    assert len(window) == 2 * 72 and window.pred.notna().all()


def test_trees_of_one_node_and_sql():
    lone = forest.Forest.build(("x",), [{0: (-1, 0.0, -1, -1, 2.5)}])
    assert lone.depth == 0 and lone.sql({"x": "x"}) == "((2.5::DOUBLE))"
    two = forest.Forest.build(("x",), [{0: (0, 1.0, 1, 2, 0.0), 1: (-1, 0.0, -1, -1, 3.0), 2: (-1, 0.0, -1, -1, 4.0)}])
    assert "CASE WHEN x <= 1.0 THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END" in two.sql({"x": "x"})


def test_lone_root_predicts(spark):
    lone = forest.Forest.build(("x",), [{0: (-1, 0.0, -1, -1, 2.5)}, {0: (0, 1.0, 1, 2, 0.0), 1: (-1, 0.0, -1, -1, 3.0), 2: (-1, 0.0, -1, -1, 4.0)}])
    got = spark.createDataFrame([(1.0,), (1.5,)], "x double").select(lone.predict({"x": F.col("x")}).alias("p")).collect()
    assert [r.p for r in got] == [5.5, 6.5]

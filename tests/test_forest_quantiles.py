import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourloom.plans import models
from hourloom.plans.forest_quantiles import fit_forest_quantiles

from .helpers import hours


def wave(n, seed, series=("a", "b")):
    """Noise whose width changes smoothly with the inputs; a third of the rows of b hold one value."""
    rng = np.random.default_rng(seed)
    parts = []
    for k, s in enumerate(series):
        x, z = rng.uniform(0, 6, n), rng.uniform(0, 6, n)
        y = 20 * np.sin(x) + 4 * z + rng.normal(size=n) * (1 + x)
        if k:
            y[: n // 3] = 7.0
        parts.append(pd.DataFrame({"series_id": s, "ts": hours("2024-01-01", n), "x": x, "z": z, "demand_gw": y}))
    return pd.concat(parts, ignore_index=True)


def brute(train_leaves, y, leaves, q):
    same = train_leaves == leaves
    weight = (same / same.sum(axis=0)).mean(axis=1)
    order = np.argsort(y, kind="stable")
    return y[order][np.searchsorted(np.cumsum(weight[order]), q - 1e-9)]


@pytest.fixture(scope="module")
def fitted(spark):
    train, test = wave(700, 1), wave(60, 2)
    return train, test, fit_forest_quantiles(spark.createDataFrame(train), ["x", "z"], trees=12, depth=5, smallest=5)


def test_bounds_equal_brute_force_weights(spark, fitted):
    train, test, fit = fitted
    assert fit.rounds == 2  # 1,400 targets: blocks within blocks
    by_row = lambda pdf: np.array(fit.placed(spark.createDataFrame(pdf)).orderBy("series_id", "ts").toPandas()["_leaves"].tolist())
    got = fit.bounds(spark.createDataFrame(test)).orderBy("series_id", "ts").toPandas()
    train_leaves, test_leaves = by_row(train), by_row(test)
    y = train.sort_values(["series_id", "ts"]).demand_gw.to_numpy()
    assert len(got) == len(test) and list(got.columns) == [*test.columns, "lower", "median", "upper"]
    for name, q in models.INTERVAL_LEVELS.items():
        np.testing.assert_array_equal(got[name], [brute(train_leaves, y, row, q) for row in test_leaves])


def test_loss_is_below_that_of_a_single_tree(spark, fitted):
    train, _, _ = fitted
    test = spark.createDataFrame(wave(400, 3))
    y = F.col("demand_gw")

    def loss(bounds):
        parts = [F.avg(F.greatest((y - F.col(n)) * q, (F.col(n) - y) * (1 - q))) for n, q in models.INTERVAL_LEVELS.items()]
        return sum(bounds.agg(*parts).head())

    rows = spark.createDataFrame(train)
    forest = fit_forest_quantiles(rows, ["x", "z"], trees=30)
    assert loss(forest.bounds(test)) < loss(models.fit_leaf_quantiles(rows, ["x", "z"]).bounds(test))


def test_one_value_and_rows_without_target(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 5.0), ("a", 3.0, None)], "series_id string, x double, demand_gw double")
    got = fit_forest_quantiles(rows, ["x"], trees=3).bounds(rows)
    assert {(r.lower, r.median, r.upper) for r in got.collect()} == {(5.0, 5.0, 5.0)} and got.count() == 3
    assert fit_forest_quantiles(rows, ["x"], trees=3).bounds(rows.limit(0)).count() == 0


def test_no_row_meets_the_members_of_its_leaves(spark, fitted):
    _, test, fit = fitted
    assert fit.counts.agg(F.max(F.size("_parts"))).head()[0] <= 256
    plan = fit.bounds(spark.createDataFrame(test))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

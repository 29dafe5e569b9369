import random

from pyspark.sql import functions as F

from hourloom.operators.intervals import dyadic_blocks, interval_join


def test_blocks_cover_an_interval_once(spark):
    cases = [(0, 0), (5, 3), (0, 1), (-7, 9), (3, 1000), (-(2 ** 40), 2 ** 40 + 5), (2 ** 61, 2 ** 61 + 1)]
    rows = spark.createDataFrame(cases, "low bigint, high bigint").select("low", "high", dyadic_blocks(F.col("low"), F.col("high")).alias("b")).collect()
    for r in rows:
        spans = sorted((b["block"] << b["level"], (b["block"] + 1) << b["level"]) for b in r.b)
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        if r.low < r.high:
            assert (spans[0][0], spans[-1][1]) == (r.low, r.high) and len(spans) <= 2 * 62
        else:
            assert not spans


def test_join_equals_brute_force_without_a_nested_loop(spark):
    rng = random.Random(1)
    points = [(rng.choice("ab"), rng.randrange(-300, 300)) for _ in range(400)] + [("a", None), (None, 3), ("hot", 7), ("hot", 7)]
    spans = [(rng.choice("ab"), k, (low := rng.randrange(-300, 300)), low + rng.choice([0, 1, 2, 17, 64, 250])) for k in range(80)]
    spans += [("a", 90, 5, 5), ("a", 91, 9, 2), ("a", 92, None, 5), ("hot", 93, 0, 10), ("hot", 94, 7, 8), ("c", 95, 0, 9)]
    p = spark.createDataFrame(points, "series_id string, at bigint")
    s = spark.createDataFrame(spans, "series_id string, fold int, low bigint, high bigint")
    out = interval_join(p, s, F.col("at"), F.col("low"), F.col("high"))
    want = sorted((k, a, f) for k, a in points for k2, f, lo, hi in spans if k is not None and k == k2 and a is not None and lo is not None and lo <= a < hi)
    assert sorted((r.series_id, r["at"], r.fold) for r in out.collect()) == want and len(want) > 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert interval_join(p, s.where("false"), F.col("at"), F.col("low"), F.col("high")).count() == 0

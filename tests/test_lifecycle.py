import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourloom.plans import lifecycle
from hourloom.schemas import LOAD_PAGE
from hourloom.session import scratch
from hourloom.sources import pages, publish
from hourloom.sources.registry import load_runs

from .helpers import demand

DAY, NEXT = "2023-01-20 00:00:00", "2023-01-27 00:00:00"


def naive(error):
    """Predictions off by a known percentage."""
    def fit(train, test):
        pred = test.select("series_id", "ts", F.col("demand_gw").alias("actual"), F.lit("m").alias("model"), (F.col("demand_gw") * (1 + error / 100)).alias("pred"))
        return lifecycle.Fitted(pred, lambda path: train.limit(1).write.parquet(path))
    return fit


def retrain(spark, root, rows, run_ts, error, upto, fit=None):
    seen = []

    def watched(train, test):
        seen.append((train.agg(F.max("ts")).head()[0], test.agg(F.max("ts")).head()[0]))
        return (fit or naive(error))(train, test)

    increment = rows.where(F.col("ts") < F.lit(upto).cast("timestamp")).drop("temperature_f")
    run = lifecycle.run_retrain(spark, root, rows.where("ts < timestamp'2023-01-10'"), increment, run_ts, "2023-01-12", watched)
    return run, seen


def test_second_run_starts_from_the_stored_end(spark):
    rows, root = spark.createDataFrame(demand(800, series=("a", "b"))), scratch(spark, "life")
    first, _ = retrain(spark, root, rows, DAY, 1.0, "2023-01-20")
    assert first.promoted and first.version.version == 1
    state = {r.series_id: r for r in lifecycle.published_state(spark, root).collect()}
    assert {str(r.last_end_date) for r in state.values()} == {"2023-01-19"} and state["a"].baseline_mape == pytest.approx(1.0, abs=1e-3)
    # Rows before the stored end are not read again: they could only differ from what is stored.
    wrong = rows.withColumn("demand_gw", F.when(F.col("ts") < F.lit("2023-01-19").cast("timestamp"), 1e6).otherwise(F.col("demand_gw")))
    second, seen = retrain(spark, root, wrong, NEXT, 1.02, "2023-01-27")
    assert second.version.version == 2 and str(seen[0][1]) == "2023-01-26 23:00:00"
    stored = spark.read.parquet(second.version.parts["demand"])
    assert stored.agg(F.max("demand_gw")).head()[0] < 1000 and stored.count() == 2 * 26 * 24
    # Played again, a run changes nothing.
    again, seen = retrain(spark, root, rows, NEXT, 50.0, "2023-01-27")
    assert again.run_id == second.run_id and again.version == second.version and not seen
    assert load_runs(spark, f"{root}/registry").count() == 2


def test_rejected_run_changes_the_registry_only(spark):
    rows, root = spark.createDataFrame(demand(800)), scratch(spark, "life")
    retrain(spark, root, rows, DAY, 1.0, "2023-01-20")
    before = publish.current(spark, root)
    run, _ = retrain(spark, root, rows, NEXT, 9.0, "2023-01-27")
    assert not run.promoted and publish.current(spark, root) == before
    assert [r.outcome for r in run.decisions.collect()] == ["REJECTED"]
    assert {r.metrics["promoted"] for r in load_runs(spark, f"{root}/registry").collect()} == {0.0, 1.0}


@pytest.mark.parametrize("broken", ["demand", "state", "decisions", "model", "manifest"])
def test_crash_leaves_the_old_version_readable(spark, monkeypatch, broken):
    root = scratch(spark, "crash")
    table = spark.range(3)
    old = publish.publish(spark, root, "one", {n: table.write.parquet for n in ("demand", "state", "decisions", "model")}, None)

    def fail(*_):
        raise OSError("lost")

    parts = {n: (fail if n == broken else spark.range(9).write.parquet) for n in ("demand", "state", "decisions", "model")}
    if broken == "manifest":
        monkeypatch.setattr(publish, "_place", fail)
    with pytest.raises(OSError):
        publish.publish(spark, root, "two", parts, old)
    monkeypatch.undo()
    now = publish.current(spark, root)
    assert now == old and all(spark.read.parquet(p).count() == 3 for p in now.parts.values())
    # The run is played again and goes through; a part that it does not write stays.
    new = publish.publish(spark, root, "two", {"state": spark.range(9).write.parquet}, old)
    assert publish.current(spark, root) == new and new.version == 2 and new.parts["model"] == old.parts["model"]
    assert spark.read.parquet(new.parts["state"]).count() == 9


def test_two_publishers_do_not_overwrite_each_other(spark):
    root = scratch(spark, "race")
    old = publish.publish(spark, root, "one", {"state": spark.range(1).write.parquet}, None)
    publish.publish(spark, root, "two", {"state": spark.range(2).write.parquet}, old)
    with pytest.raises(publish.PublishedMeanwhile):
        publish.publish(spark, root, "three", {"state": spark.range(3).write.parquet}, old)
    assert publish.current(spark, root).run_id == "two"


def page(series, offset, total, periods):
    return (series, offset, (str(total), [(p, "1") for p in periods]))


def hours(start, n):
    return [f"2024-01-{1 + h // 24:02d}T{h % 24:02d}" for h in range(start, start + n)]


def test_pages_are_reconciled(spark):
    rows = [
        page("whole", 0, 7, hours(0, 5)), page("whole", 5, 7, hours(5, 2)), page("whole", 7, 7, []),
        page("lost", 0, 12, hours(0, 5)), page("lost", 10, 12, hours(10, 2)),
        page("twice", 0, 7, hours(0, 5)), page("twice", 0, 7, hours(0, 5)), page("twice", 5, 7, hours(5, 2)),
        page("overlap", 0, 8, hours(0, 5)), page("overlap", 3, 8, hours(3, 5)),
        page("shifted", 0, 10, hours(0, 5)), page("shifted", 5, 10, hours(4, 5)),
        page("grown", 0, 7, hours(0, 5)), page("grown", 5, 8, hours(5, 3)),
        page("short", 0, 9, hours(0, 5)), page("short", 5, 9, []),
        ("unread", None, ("n/a", [("2024-01-01T00", "1")])), ("none", 0, (None, None)),
    ]
    report = {r.series_id: r for r in pages.reconcile_pages(spark.createDataFrame(rows, LOAD_PAGE)).collect()}
    get = lambda s: tuple(report[s])[1:]
    #      total, pages, rows, missing, repeated rows, repeated pages, shifted, totals differ, first empty, complete
    assert get("whole") == (7, 3, 7, 0, 0, 0, 0, False, 7, True)
    assert get("lost") == (12, 2, 7, 5, 0, 0, 0, False, None, False)
    assert get("twice") == (7, 3, 12, 0, 5, 1, 0, False, None, True)
    assert get("overlap") == (8, 2, 10, 0, 2, 0, 0, False, None, True)
    assert get("shifted") == (10, 2, 10, 0, 0, 0, 1, False, None, False)
    assert get("grown") == (8, 2, 8, 0, 0, 0, 0, True, None, False)
    assert get("short") == (9, 2, 5, 4, 0, 0, 0, False, 5, False)
    assert not report["unread"].complete and not report["none"].complete
    assert pages.reconcile_pages(spark.createDataFrame([], LOAD_PAGE)).count() == 0


def test_landed_pages_state_offsets_and_totals(spark):
    rows = spark.createDataFrame(pd.concat([demand(250), demand(90, series=("b",))]))
    landed = pages.load_pages(rows, F.lit(1), page_size=100)
    report = {r.series_id: r for r in pages.reconcile_pages(landed).collect()}
    assert report["a"].total == 250 and report["b"].total == 90 and all(r.complete for r in report.values())

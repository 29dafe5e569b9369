"""The scheduled retrain from the stored version to the next one.

A run reads what is published (demand, state per series, model), merges the rows that came after
each series' stored end date, rebuilds the features, fits, scores the hold-out and passes the gate.
It logs one run record whatever the outcome. Only if a series is promoted are demand, state,
decisions and model published, in one step (``sources.publish``); a rejected run changes nothing
but the registry. The run id follows from the version it started from and its time, so a run that
is played again logs and publishes nothing twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import fill_temperature, union_prefer_first
from ..operators.metrics import metrics_by_model
from ..operators.split import temporal_split
from ..session import KEY, path_exists, stored
from ..sources.publish import Published, current, publish
from ..sources.registry import load_runs, log_runs, run_records
from .features import build_features
from .gate import decide, next_state

STATE = f"{KEY} string, last_run timestamp, last_end_date date, baseline_mape double"


@dataclass(frozen=True)
class Fitted:
    """What a fit gives back: long predictions of the hold-out, and how to save the model."""

    predictions: DataFrame
    save: Callable[[str], None]


@dataclass(frozen=True)
class Run:
    run_id: str
    decisions: DataFrame
    version: Published | None
    promoted: bool


def published_state(spark: SparkSession, root: str) -> DataFrame:
    now = current(spark, root)
    return spark.createDataFrame([], STATE) if now is None else spark.read.schema(STATE).parquet(now.parts["state"])


def rows_since(increment: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of the days from each series' stored end date on; all rows of a series without one."""
    known = increment.join(state.select(KEY, "last_end_date"), KEY, "left")
    return known.where("last_end_date IS NULL OR ts >= last_end_date").drop("last_end_date")


def run_retrain(
    spark: SparkSession,
    root: str,
    seed: DataFrame,
    increment: DataFrame,
    run_ts: str,
    test_start: str | Column,
    fit: Callable[[DataFrame, DataFrame], Fitted],
    state: DataFrame | None = None,
    experiment: str = "retrain",
    **gate,
) -> Run:
    """One run. ``seed`` (demand) and ``state`` count only while nothing is published."""
    now = current(spark, root)
    version = 0 if now is None else now.version
    # A run that published is known by its time; its version is behind it when it is played again.
    for start in {version, max(version - 1, 0)}:
        run_id = hashlib.md5(f"{experiment}:{start}:{run_ts}".encode()).hexdigest()[:8]
        done = current(spark, root, run_id)
        if done is not None:
            return Run(run_id, spark.read.parquet(done.parts["decisions"]), done, True)
    run_id = hashlib.md5(f"{experiment}:{version}:{run_ts}".encode()).hexdigest()[:8]
    old = published_state(spark, root) if now is not None or state is None else state
    have = seed if now is None else spark.read.parquet(now.parts["demand"])
    merged = stored(fill_temperature(union_prefer_first(have, rows_since(increment, old))), "merged")
    features = stored(build_features(merged), "retrain-features")
    train, test = temporal_split(features, test_start)
    fitted = fit(train, test)
    metrics = metrics_by_model(fitted.predictions, (KEY,)).select(KEY, F.col("mape").alias("new_mape"))
    ends = merged.groupBy(KEY).agg(F.to_date(F.max("ts")).alias("new_end_date"), F.count("*").alias("data_rows"))
    decisions = stored(decide(metrics.join(ends, KEY), old, **gate), "decisions")
    promoted = not decisions.where("outcome = 'PROMOTED'").isEmpty()
    log_once(spark, f"{root}/registry", _record(decisions, run_id, experiment, run_ts))
    if not promoted:
        return Run(run_id, decisions, now, False)
    after = stored(next_state(decisions, old, run_ts), "state")
    parts = {"demand": merged.write.parquet, "state": after.select(*[f.split()[0] for f in STATE.split(", ")]).write.parquet,
             "decisions": decisions.write.parquet, "model": fitted.save}
    return Run(run_id, decisions, publish(spark, root, run_id, parts, now), True)


def _record(decisions: DataFrame, run_id: str, experiment: str, run_ts: str) -> DataFrame:
    """One record of a run: how many series, how many promoted, the mean error."""
    found = decisions.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "PROMOTED").alias("k"), F.avg("new_mape").alias("mape"),
                          F.max("new_end_date").alias("end"))
    records = run_records(
        found, F.lit(f"{experiment}-{run_id}"), experiment, F.lit(run_ts).cast("timestamp"),
        F.create_map(F.lit("series"), F.col("n").cast("string"), F.lit("last_training_ts"), F.col("end").cast("string")),
        F.create_map(F.lit("mape"), F.col("mape"), F.lit("promoted"), F.col("k").cast("double")),
        F.create_map(F.lit("model"), F.lit(experiment)))
    return records.withColumn("run_id", F.lit(run_id))


def log_once(spark: SparkSession, registry: str, record: DataFrame) -> None:
    """Append a run record unless the registry has its run."""
    run_id = record.head()["run_id"]
    if not path_exists(spark, registry) or load_runs(spark, registry).where(F.col("run_id") == run_id).isEmpty():
        log_runs(record, registry)

"""Promotion gate and the scheduled retrain built from the other plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import fill_temperature, union_prefer_first
from ..operators.metrics import metrics_by_model
from ..operators.split import temporal_split
from ..session import KEY, stored
from .features import build_features

# Relative tolerance, first baseline and first end date.
TOLERANCE = 0.05
FIRST_BASELINE = 1.52
FIRST_END = "2024-01-01"


def decide(new: DataFrame, state: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Decision per series: promoted when the new MAPE is within tolerance of the baseline.

    ``new`` has ``series_id, new_mape, new_end_date``; ``state`` has
    ``series_id, baseline_mape, last_end_date``; unknown series start from the
    first baseline.
    """
    joined = new.join(state, KEY, "left").withColumn(
        "baseline_mape", F.coalesce("baseline_mape", F.lit(FIRST_BASELINE))
    )
    limit = F.col("baseline_mape") * (1 + tolerance)
    return joined.withColumn("gate_limit", limit).withColumn(
        "outcome", F.when(F.col("new_mape") <= limit, "PROMOTED").otherwise("REJECTED")
    )


def next_state(decisions: DataFrame, state: DataFrame, run_ts: str, fixed_baseline: bool = False) -> DataFrame:
    """State after the gate: promoted series move on, all others keep their row.

    By default the baseline follows each promoted model; ``fixed_baseline``
    keeps the first one.
    """
    promoted = decisions.where("outcome = 'PROMOTED'").select(
        KEY,
        F.lit(run_ts).cast("timestamp").alias("last_run"),
        F.col("new_end_date").alias("last_end_date"),
        (F.col("baseline_mape") if fixed_baseline else F.col("new_mape")).alias("baseline_mape"),
    )
    return promoted.unionByName(state.join(promoted, KEY, "left_anti"), allowMissingColumns=True)


def retrain(
    existing: DataFrame,
    increment: DataFrame,
    state: DataFrame,
    test_start: str,
    fit_and_score: Callable[[DataFrame, DataFrame], DataFrame],
    enrich: bool = True,
    **gate,
) -> DataFrame:
    """Merge new rows, rebuild features, fit, score the hold-out and decide per series.

    New rows carry no temperature. With ``enrich`` it is filled before the
    features; without, those rows fall out as incomplete.
    """
    merged = union_prefer_first(existing, increment)
    if enrich:
        merged = fill_temperature(merged)
    features = stored(build_features(merged), "retrain-features")
    train, test = temporal_split(features, test_start)
    metrics = metrics_by_model(fit_and_score(train, test), (KEY,)).select(KEY, F.col("mape").alias("new_mape"))
    ends = merged.groupBy(KEY).agg(F.to_date(F.max("ts")).alias("new_end_date"), F.count("*").alias("data_rows"))
    return decide(metrics.join(ends, KEY), state, **gate)

"""Readers and writers of stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import time_bucket
from ..schemas import DEMAND
from ..session import KEY


def read_demand_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEMAND).csv(path, header=True)


def read_demand(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEMAND).parquet(path)


def read_predictions(spark: SparkSession, files: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Stored wide predictions of several models as one long table.

    ``files`` maps a model name to ``(path, prediction column)``. A file without
    its prediction column is skipped, actuals in MW are converted, and bounds
    are kept where a file has them.
    """
    out = None
    for model, (path, column) in files.items():
        wide = spark.read.csv(path, header=True)
        if column not in wide.columns:
            continue
        number = lambda name: F.col(name).try_cast("double")
        actual = number("demand_gw") if "demand_gw" in wide.columns else number("demand_mw") / 1000
        part = wide.select(
            KEY,
            F.col("timestamp").try_cast("timestamp").alias("ts"),
            actual.alias("actual"),
            F.lit(model).alias("model"),
            number(column).alias("pred"),
            *[number(c).alias(c) for c in ("lower_gw", "upper_gw") if c in wide.columns],
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file has its prediction column")
    return out


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (KEY,), mode: str = "overwrite") -> None:
    """Write Parquet, spreading each series over its time buckets.

    A folder per series suits few series; pass ``partition_by=("year",)`` (added
    here from ``ts``) when there are many.
    """
    rows = df.withColumn("year", F.year("ts")) if "year" in partition_by else df
    rows.repartition(KEY, time_bucket("ts")).sortWithinPartitions(KEY, "ts").write.mode(mode).partitionBy(
        *partition_by
    ).parquet(path)


def append_forecast(points: DataFrame, path: str, run_ts: str) -> None:
    """Append one batch of forecast points keyed by series and run time."""
    points.withColumn("run_ts", F.lit(run_ts).cast("timestamp")).write.mode("append").partitionBy("run_ts").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)

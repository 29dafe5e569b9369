"""Temporal train / calibration / test splits and feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import with_positions

# Default split date, calibration length, non-feature columns.
TEST_START = "2024-10-01"
CALIBRATION_ROWS = 720
NOT_FEATURES = ("demand_gw", "timestamp", "temperature_f", "temp_f")


def temporal_split(df: DataFrame, test_start: str = TEST_START) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(test_start).cast("timestamp")
    return df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut)


def label_splits(df: DataFrame, test_start: str = TEST_START, calibration: int = CALIBRATION_ROWS) -> DataFrame:
    """Add ``split`` = train / calibration / test; calibration is the tail before the cut."""
    train, test = temporal_split(df, test_start)
    marked = with_positions(train).withColumn(
        "split", F.when(F.col("_pos") >= F.col("_n") - calibration, "calibration").otherwise("train")
    ).drop("_pos", "_n")
    return marked.unionByName(test.withColumn("split", F.lit("test")))


def feature_columns(df: DataFrame, keys=("series_id", "ts")) -> list[str]:
    """Every column that is neither a key, the target nor the raw temperature, in order."""
    return [c for c in df.columns if c not in NOT_FEATURES and c not in keys]


def fill_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0, subset=columns)

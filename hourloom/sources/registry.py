"""Run registry: append-only run records, leaderboard and current models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.ml import PipelineModel

from ..schemas import RUN
from ..session import path_exists


def run_id(name: Column, start_time: Column) -> Column:
    """First eight hex digits of the md5 of name and start time."""
    return F.substring(F.md5(F.concat(name, start_time.cast("string"))), 1, 8)


def run_records(
    df: DataFrame,
    run_name: Column,
    experiment: str,
    start_time: Column,
    params: Column,
    metrics: Column,
    tags: Column | None = None,
    artifacts: Column | None = None,
) -> DataFrame:
    """One finished run record per row of ``df``."""
    empty_map = F.create_map().cast("map<string,string>")
    empty_list = F.array().cast("array<string>")
    start = start_time.cast("timestamp")
    return df.select(
        run_id(run_name, start_time).alias("run_id"),
        run_name.alias("run_name"),
        F.lit(experiment).alias("experiment"),
        start.alias("start_time"),
        F.lit("FINISHED").alias("status"),
        params.cast("map<string,string>").alias("params"),
        metrics.cast("map<string,double>").alias("metrics"),
        (empty_map if tags is None else tags.cast("map<string,string>")).alias("tags"),
        (empty_list if artifacts is None else artifacts.cast("array<string>")).alias("artifacts"),
    )


def log_runs(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """All run records in record-name order."""
    return spark.read.schema(RUN).json(path).orderBy("run_name", "run_id")


def leaderboard(runs: DataFrame, metric: str = "mape") -> DataFrame:
    """Runs of each experiment ranked by a metric, best first."""
    best = Window.partitionBy("experiment").orderBy(F.col("score").asc_nulls_last(), "run_name", "run_id")
    return runs.withColumn("score", F.col("metrics")[metric]).withColumn("rank", F.row_number().over(best))


def current_models(runs: DataFrame) -> DataFrame:
    """Latest run per model tag with its loaded flag, feature count and metrics."""
    latest = runs.groupBy(F.col("tags")["model"].alias("model")).agg(
        F.max_by(F.struct("run_id", "start_time", "params", "metrics"), F.struct("start_time", "run_id")).alias("_r")
    )
    return latest.select(
        "model",
        F.lit(True).alias("loaded"),
        F.col("_r.run_id").alias("run_id"),
        F.col("_r.params")["feature_count"].cast("int").alias("feature_count"),
        F.to_date(F.col("_r.params")["last_training_ts"]).alias("last_training_date"),
        F.col("_r.metrics")["mape"].alias("mape"),
        F.col("_r.metrics")["mae"].alias("mae"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, *folders: str) -> PipelineModel:
    """Load from the first folder that holds a saved model."""
    for folder in folders:
        if path_exists(spark, f"{folder.rstrip('/')}/metadata"):
            return PipelineModel.load(folder)
    raise FileNotFoundError(f"no saved model in {', '.join(folders)}")

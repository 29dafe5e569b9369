"""Structured Streaming forms of the incremental steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import dedup_first
from ..operators.joins import fill_temperature, join_weather, new_rows_only
from ..session import KEY, path_exists, scratch

# Reporting lag of the load service.
LATE_LOAD = "2 days"
LATE_WEATHER = "6 days"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet", watermark: str = LATE_LOAD) -> DataFrame:
    """Files of a folder as a stream with event time ``ts`` and a lateness allowance."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def hourly_tumbling(events: DataFrame) -> DataFrame:
    """Hourly sums per event type."""
    hours = F.window("ts", "1 hour")
    return events.groupBy(F.col("event_type").alias(KEY), hours).agg(F.sum("value").alias("demand_gw")).select(
        KEY, F.col("window.start").alias("ts"), "demand_gw"
    )


def dedup(events: DataFrame, *keys: str) -> DataFrame:
    """Drop repeats that arrive within the watermark delay."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Process what is available now, batch by batch, and stop."""
    folder = checkpoint or scratch(stream.sparkSession, "stream")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", folder)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()


def versioned_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for update mode: every batch overwrites its own folder, so a replay repeats it exactly."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def latest_versions(spark: SparkSession, path: str, keys=(KEY, "ts")) -> DataFrame:
    """Last version of each key written by ``versioned_sink``."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
    return picked.select(*keys, "_r.*")


def _near(spark: SparkSession, path: str, batch: DataFrame, others: Column, hours: int = 0) -> DataFrame | None:
    """Rows stored by ``others`` among the batches, in the time range of this one, widened by ``hours`` on both sides.

    The store is partitioned by batch and day, so only the days in range are listed and read.
    """
    low, high = batch.agg(F.min("ts"), F.max("ts")).head()
    if low is None or not path_exists(batch.sparkSession, path):
        return None
    wide = F.make_dt_interval(hours=F.lit(hours))
    days = F.col("day").between(F.to_date(F.lit(low) - wide), F.to_date(F.lit(high) + wide))
    return spark.read.parquet(path).where(others & days).drop("day", "batch_id")


def _store(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch_id}")


def merge_sink(path: str, keys=(KEY, "ts"), tie_break: str | None = None) -> Callable[[DataFrame, int], None]:
    """Insert-only merge: stored keys win. The checkpoint takes the place of a state file.

    Each batch goes to a folder of its own and is compared with the rows of the same days in
    the earlier folders only, so a replayed batch neither loses nor repeats rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        unique = dedup_first(batch, tie_break, keys) if tie_break else batch.dropDuplicates(list(keys))
        stored = _near(batch.sparkSession, path, batch, F.col("batch_id") < batch_id)
        _store(unique if stored is None else new_rows_only(stored, unique, keys), path, batch_id)

    return write


def enrich_weather(stream: DataFrame, temperature: DataFrame) -> DataFrame:
    """Stream-static lookup of the hour's temperature, with the unrounded proxy as fallback."""
    return fill_temperature(join_weather(stream, temperature), decimals=None)


LAGS = (1, 24, 168)


def lag_sink(values: str, out: str, lags=LAGS) -> Callable[[DataFrame, int], None]:
    """Lags by time of a stream of hourly rows, right for any order of arrival.

    A batch stores its values and then writes, as its own version, the lags of every row that
    it touches: its own rows, and stored rows that a late value is a lag of. It reads stored
    values of its time range widened by the longest lag, joined by series and hour, so no
    series gathers in one task. Read the result with ``latest_versions``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(KEY, "ts", "demand_gw").where(F.col(KEY).isNotNull() & F.col("ts").isNotNull()).dropDuplicates([KEY, "ts"])
        _store(new, values, batch_id)
        new = spark.read.parquet(f"{values}/batch_id={batch_id}").drop("day")
        stored = _near(spark, values, new, F.col("batch_id") != batch_id, max(lags))
        known = new if stored is None else new.unionByName(stored.join(new, [KEY, "ts"], "left_anti"))
        later = lambda h: (F.col("ts") + F.make_dt_interval(hours=h)).alias("ts")
        touched = new.select(KEY, F.explode(F.array(F.lit(0), *map(F.lit, lags))).alias("_h"), "ts").select(KEY, later(F.col("_h"))).distinct()
        result = known.join(touched, [KEY, "ts"], "left_semi")
        for k in lags:
            result = result.join(known.select(KEY, later(F.lit(k)), F.col("demand_gw").alias(f"lag_{k}")), [KEY, "ts"], "left")
        result.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write

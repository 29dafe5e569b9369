"""Landed API pages (JSON) as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.buckets import hour_index
from ..operators.clean import parse_period_loose
from ..schemas import LOAD_PAGE, WEATHER_PAGE
from ..session import KEY

# Page length and forecast horizon limits of the remote services.
PAGE_SIZE = 5000
FORECAST_DAYS = (1, 16)


def read_load_pages(spark: SparkSession, path: str) -> DataFrame:
    """All landed load pages as ``(series_id, period, value)``; empty pages vanish."""
    return load_rows(spark.read.schema(LOAD_PAGE).json(path))


def load_rows(pages: DataFrame) -> DataFrame:
    return pages.select(KEY, F.explode("response.data").alias("_r")).select(KEY, "_r.period", "_r.value")


def load_increment(rows: DataFrame | None, stored: DataFrame, since: Column) -> DataFrame:
    """Whole-MWh rows after ``since`` as GW; the stored rows after it when nothing was fetched."""
    if rows is None:
        return stored.where(F.col("ts") > since).select(KEY, "ts", "demand_gw")
    typed = rows.select(
        KEY,
        parse_period_loose(F.col("period")).alias("ts"),
        (F.col("value").try_cast("bigint") / 1000).alias("demand_gw"),
    )
    return typed.where((F.col("ts") > since) & F.col("demand_gw").isNotNull())


def read_weather_pages(spark: SparkSession, path: str) -> DataFrame:
    return weather_rows(spark.read.schema(WEATHER_PAGE).json(path))


def weather_rows(pages: DataFrame) -> DataFrame:
    """Parallel arrays of times and temperatures as ``(ts, temperature_f)``."""
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), F.col("hourly.temperature_2m").alias("temp"))
    return pages.select(F.explode(zipped).alias("_z")).select(
        F.try_to_timestamp(F.col("_z.time"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts"),
        F.col("_z.temp").cast("double").alias("temperature_f"),
    )


def clamp_days(days: Column) -> Column:
    """Requested forecast days limited to what the service offers."""
    return F.least(F.lit(FORECAST_DAYS[1]), F.greatest(F.lit(FORECAST_DAYS[0]), days))


def load_pages(df: DataFrame, value: Column, page_size: int = PAGE_SIZE) -> DataFrame:
    """Rows packed into page structs of at most ``page_size`` hours, for landing as JSON, each with
    the offset it was asked for and the total that the service states."""
    page = F.floor(hour_index("ts") / page_size)
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH").alias("period"), value.cast("string").alias("value"))
    packed = df.groupBy(KEY, page.alias("_page")).agg(F.array_sort(F.collect_list(item)).alias("data")).withColumn("_n", F.size("data"))
    # A row per page: a series of a hundred years has 176.
    before = Window.partitionBy(KEY).orderBy("_page")
    return packed.select(
        KEY, (F.sum("_n").over(before) - F.col("_n")).alias("offset"),
        F.struct(F.sum("_n").over(Window.partitionBy(KEY)).cast("string").alias("total"), "data").alias("response"))


def reconcile_pages(pages: DataFrame) -> DataFrame:
    """Per series, what the landed pages hold of the rows that the service states.

    A page covers the offsets from its own up to its rows; pages may be missing, landed twice,
    or shifted (the service's rows moved between two requests, so that neighbours meet in
    periods though not in offsets, or the stated total changes). ``first_empty`` is the offset
    of the first page without rows, where paging has to stop.

    Result: total (largest stated one), n_pages, n_rows, missing_rows, repeated_rows,
    repeated_pages, shifted_pages, totals, first_empty, complete. Pages without an offset or a
    readable total are counted in ``n_pages`` only; a series of such pages is not complete.
    """
    # Landed twice: one page per offset, the one with most rows, counts.
    page = pages.select(
        KEY, "offset", F.expr("try_cast(response.total AS BIGINT)").alias("total"), F.coalesce(F.size("response.data"), F.lit(0)).alias("_size"),
        F.array_min("response.data.period").alias("_low"), F.array_max("response.data.period").alias("_high"))
    once = page.groupBy(KEY, "offset").agg(
        F.max(F.struct(F.greatest("_size", F.lit(0)).alias("_size"), "_low", "_high")).alias("_p"), F.count("*").alias("_times"),
        F.sum(F.greatest("_size", F.lit(0))).alias("_rows"), F.max("total").alias("_most"), F.min("total").alias("_least")).select(
        KEY, "offset", "_p.*", "_times", "_rows", "_most", "_least", (F.col("offset") + F.col("_p._size")).alias("_end"))
    order = Window.partitionBy(KEY).orderBy("offset")
    reached = F.coalesce(F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.last(F.when(F.col("_size") > 0, F.col("_high")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = once.withColumns({"_reached": reached, "_last": last})
    known = F.col("offset").isNotNull()
    fresh = F.greatest(F.col("_end") - F.greatest("offset", "_reached"), F.lit(0))
    shifted = known & (F.col("_size") > 0) & (F.col("offset") >= F.col("_reached")) & (F.col("_low") <= F.col("_last"))
    out = placed.groupBy(KEY).agg(
        F.max("_most").alias("total"), F.sum("_times").alias("n_pages"), F.sum(F.when(known, F.col("_rows")).otherwise(0)).alias("n_rows"),
        F.sum(F.when(known, fresh).otherwise(0)).alias("_covered"), F.sum(F.when(known, F.col("_times") - 1).otherwise(0)).alias("repeated_pages"),
        F.count_if(shifted).alias("shifted_pages"), F.min("_least").alias("_least"),
        F.min(F.when(F.col("_size") <= 0, F.col("offset"))).alias("first_empty"))
    missing = F.greatest(F.col("total") - F.col("_covered"), F.lit(0))
    return out.select(
        KEY, "total", "n_pages", "n_rows", missing.alias("missing_rows"), (F.col("n_rows") - F.col("_covered")).alias("repeated_rows"),
        "repeated_pages", "shifted_pages", (F.col("total") != F.col("_least")).alias("totals_differ"), "first_empty",
        F.coalesce((missing == 0) & (F.col("shifted_pages") == 0) & (F.col("total") == F.col("_least")) & (F.col("_covered") == F.col("total")), F.lit(False)).alias("complete"))


def weather_pages(df: DataFrame) -> DataFrame:
    """Hourly temperatures packed into one page of parallel arrays per day."""
    item = F.struct("ts", "temperature_f")
    return (
        df.groupBy(F.to_date("ts").alias("_day"))
        .agg(F.array_sort(F.collect_list(item)).alias("rows"))
        .select(
            F.struct(
                F.transform("rows", lambda r: F.date_format(r["ts"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
                F.col("rows.temperature_f").alias("temperature_2m"),
            ).alias("hourly")
        )
    )

"""Window primitives that never put one whole series into one task.

A window partitioned by ``series_id`` alone gives a long or hot series a single
task. Every primitive here cuts a series into fixed-width time buckets and makes
``(series_id, bucket)`` the shuffle key. What has to cross a bucket border is
carried either by a bounded halo of copied rows (``with_halo``) or by a summary
table with one row per bucket (``with_neighbours``, ``with_positions``). All of
them return exactly what the unsplit window would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BUCKET_HOURS, KEY

KEYS = (KEY,)


def hour_index(ts: Column | str = "ts") -> Column:
    """Hours since the epoch, as a long."""
    return F.floor(F.unix_timestamp(ts) / 3600)


def time_bucket(ts: Column | str = "ts", width: int = BUCKET_HOURS) -> Column:
    return F.floor(F.unix_timestamp(ts) / (3600 * width))


def with_halo(
    df: DataFrame,
    back: int,
    position: Column | None = None,
    width: int = BUCKET_HOURS,
) -> DataFrame:
    """Copy each row into every later bucket that looks back to it.

    ``position`` numbers the rows of a series without gaps; it defaults to the
    hour, which is right for gap-filled series. At most ``back / width`` of the
    rows are copied. Evaluate windows over ``halo_window()`` and then call
    ``drop_halo``.
    """
    at = hour_index() if position is None else position
    return (
        df.withColumn("_at", at)
        .withColumn("_own", F.floor(F.col("_at") / width))
        .withColumn("_bucket", F.explode(F.sequence(F.col("_own"), F.floor((F.col("_at") + back) / width))))
    )


def halo_window(keys: Sequence[str] = KEYS):
    return Window.partitionBy(*keys, "_bucket").orderBy("_at")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_bucket = _own").drop("_bucket", "_own", "_at", "_day_sum", "_day_n", "_day_std")


def _packed(df: DataFrame, keys: Sequence[str], order: str, width: int, first: Sequence[str] = ()) -> DataFrame:
    """Rows as ``(keys, _bucket, _row)``, shuffled once by key and bucket.

    Both the rows and their bucket summary read ``_row`` as a whole, so neither
    branch is pruned differently and Spark reuses the one exchange instead of
    computing the input twice. Rows without key or time are dropped.
    """
    rest = [c for c in df.columns if c not in keys and c != order and c not in first]
    # Not nullable, so that a later join on it adds no filter to one branch only.
    bucket = F.coalesce(time_bucket(order, width), F.lit(0))
    return (
        present(df, [*keys, order])
        .select(*keys, bucket.alias("_bucket"), F.struct(order, *first, *rest).alias("_row"))
        .repartition(*keys, "_bucket")
    )


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where all columns are set, as the plain predicates the optimizer recognises."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def with_neighbours(
    df: DataFrame,
    payload: Sequence[str],
    side: str = "both",
    valid: str | None = None,
    keys: Sequence[str] = KEYS,
    order: str = "ts",
    width: int = BUCKET_HOURS,
) -> DataFrame:
    """Add ``_prev`` / ``_next``: the nearest row strictly before / after.

    Both are structs holding at least ``(order, *payload)``; with ``valid`` only
    rows where that column is not null count. However far away the neighbour
    is, only one summary row per bucket crosses bucket borders.
    """
    rows = _packed(df, keys, order, width, payload)
    at = "_row" if valid is None else f"if(_row.{valid} is null, null, _row)"
    names = ", ".join(keys)
    edges = rows.groupBy(*keys, "_bucket").agg(F.expr(f"min({at})").alias("_first"), F.expr(f"max({at})").alias("_last"))
    over = f"over (partition by {names} order by _bucket)"
    inside = f"over (partition by {names}, _bucket order by _row)"
    found, carried = {}, {}
    if side in ("both", "prev"):
        found["_prev"] = f"lag({at}) ignore nulls {inside}"
        carried["_prev"] = f"lag(_last) ignore nulls {over}"
    if side in ("both", "next"):
        found["_next"] = f"lead({at}) ignore nulls {inside}"
        carried["_next"] = f"lead(_first) ignore nulls {over}"
    summary = edges.select(*keys, "_bucket", *[F.expr(e).alias(f"_far{n}") for n, e in carried.items()])
    near = rows.withColumns({n: F.expr(e) for n, e in found.items()})
    return near.join(summary, [*keys, "_bucket"]).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns],
        *[F.coalesce(n, f"_far{n}").alias(n) for n in found],
    )


def with_positions(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str = "ts",
    width: int = BUCKET_HOURS,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Add ``_pos`` (0-based row number by time) and ``_n`` (rows of the series)."""
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_row")
    numbered = _packed(df, keys, order, width, tie_break).withColumns({
        "_rank": F.row_number().over(inside),
        "_end": F.lead("_bucket").over(inside).isNull(),
    })
    so_far = Window.partitionBy(*keys).orderBy("_bucket")
    # The last row of a bucket knows how many rows the bucket has.
    counts = numbered.where("_end").select(
        *keys,
        "_bucket",
        (F.sum("_rank").over(so_far) - F.col("_rank")).alias("_offset"),
        F.sum("_rank").over(Window.partitionBy(*keys)).alias("_n"),
    )
    return numbered.join(counts, [*keys, "_bucket"]).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns],
        (F.col("_offset") + F.col("_rank") - 1).alias("_pos"),
        "_n",
    )

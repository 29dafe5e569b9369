"""Exact ranks and quantiles of groups of any size.

``percentile`` builds one hash map per group in one task. Here equal values are
counted before the shuffle, and each group is range-split at approximate
quantiles into slices that are shuffled and sorted separately; only one row per
slice is combined. The approximation decides how even the slices are, never the
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import present

SLICES = 64
SALTS = 16  # a power of two


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with ``_count``, ``_before`` (rows below) and ``_n`` (rows in the group)."""
    keys = list(keys)
    counted = (
        present(df, [*keys, value])
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.count("*").alias("_count"))
    )
    levels = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    # Both branches read every column of `counted`, so its exchange is reused.
    cuts = counted.groupBy(*keys).agg(
        F.percentile_approx(F.when(F.col("_count") > 0, F.col("_value")), levels, F.lit(1000)).alias("_cuts")
    )
    # The cuts of a hot group are copied to every salt so its rows spread over tasks.
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")
    inside = Window.partitionBy(*keys, "_slice").orderBy("_value")
    sliced = (
        counted.withColumn("_salt", F.xxhash64("_value").bitwiseAND(F.lit(SALTS - 1).cast("bigint")))
        .join(cuts.withColumn("_salt", F.explode(salts)), [*keys, "_salt"])
        .withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_value"))), F.lit(0)))
        .select(*keys, "_slice", "_value", "_count")
        .repartition(*keys, "_slice")
        .withColumns({
            "_through": F.sum("_count").over(inside),
            "_end": F.lead("_value").over(inside).isNull(),
        })
    )
    so_far = Window.partitionBy(*keys).orderBy("_slice")
    # The last value of a slice knows how many rows the slice has.
    totals = sliced.where("_end").select(
        *keys,
        "_slice",
        (F.sum("_through").over(so_far) - F.col("_through")).alias("_offset"),
        F.sum("_through").over(Window.partitionBy(*keys)).alias("_n"),
    )
    return sliced.join(totals, [*keys, "_slice"]).select(
        *keys, "_value", "_count", (F.col("_offset") + F.col("_through") - F.col("_count")).alias("_before"), "_n"
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Sequence[float | Column],
) -> DataFrame:
    """Linear-interpolation quantiles: ``(keys, level, value, n_below, n_upto, n)``.

    A level may be a number or an expression of ``_n``, the group size. Values
    equal those of ``percentile``; ``n_below`` and ``n_upto`` count the rows
    below, and not above, the quantile.
    """
    wanted = []
    for level in levels:
        q = level if isinstance(level, Column) else F.lit(float(level))
        wanted.append(F.struct(q.cast("double").alias("level"), (q * (F.col("_n") - 1)).cast("double").alias("at")))
    before, through = F.col("_before"), F.col("_before") + F.col("_count")
    holds = lambda position: (position >= before) & (position < through)
    hits = F.filter(F.array(*wanted), lambda w: holds(F.floor(w["at"])) | holds(F.ceil(w["at"])))
    here = F.struct(F.col("_value").alias("v"), before.alias("below"), through.alias("upto"))
    matched = ranked_values(df, keys, value).withColumn("_hit", F.explode(hits))
    picked = (
        matched.withColumn("_at", F.col("_hit.at"))
        .groupBy(*keys, F.col("_hit.level").alias("level"), "_at", "_n")
        .agg(
            F.max(F.when(holds(F.floor("_at")), here)).alias("_lo"),
            F.max(F.when(holds(F.ceil("_at")), here)).alias("_hi"),
        )
    )
    share = F.col("_at") - F.floor("_at")
    apart = (share > 0) & (F.col("_lo.v") < F.col("_hi.v"))
    return picked.select(
        *keys,
        "level",
        (F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * share).alias("value"),
        F.when(apart, F.col("_hi.below")).otherwise(F.col("_lo.below")).alias("n_below"),
        F.when(apart, F.col("_hi.below")).otherwise(F.col("_lo.upto")).alias("n_upto"),
        F.col("_n").alias("n"),
    )

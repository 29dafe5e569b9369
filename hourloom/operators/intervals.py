"""Join of positions with the intervals that hold them, for any intervals: overlapping, nested, irregular.

An interval is cut into blocks whose size is a power of two and whose start is a multiple of it, at
most two per size; a position lies in one block of each size. So the range condition becomes an
equality of (size, block), which shuffles by hash and splits like any other join: no nested loop,
no pair that is looked at and thrown away. A position gives one row per size that occurs among the
intervals, an interval one per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import KEY

# Sizes are 2 ** level; positions are 64-bit.
LEVELS = 62


def dyadic_blocks(low: Column, high: Column) -> Column:
    """Array of (level, block) that cover ``[low, high)`` exactly once; empty if nothing lies between."""
    odd = lambda c: c.bitwiseAND(1) == 1
    block = lambda level, at: F.struct(level.alias("level"), at.alias("block"))
    none = F.array().cast("array<struct<level:int,block:bigint>>")

    def rise(s: Column, level: Column) -> Column:
        open_ = s["low"] < s["high"]
        left, right = open_ & odd(s["low"]), open_ & odd(s["high"])
        found = F.concat(s["found"], F.when(left, F.array(block(level, s["low"]))).otherwise(none),
                         F.when(right, F.array(block(level, s["high"] - 1))).otherwise(none))
        return F.struct(
            F.shiftright(s["low"] + F.when(left, 1).otherwise(0), 1).alias("low"),
            F.shiftright(s["high"] - F.when(right, 1).otherwise(0), 1).alias("high"), found.alias("found"))

    first = F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), first, rise, lambda s: s["found"])


def interval_join(points: DataFrame, intervals: DataFrame, position: Column, low: Column, high: Column, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Every row of ``points`` with every row of ``intervals`` of equal ``keys`` whose ``[low, high)`` holds
    its ``position``. Rows with a null key, position or bound meet nothing. Other columns must differ in name."""
    cut = intervals.withColumn("_z", F.explode(dyadic_blocks(low, high))).select(*intervals.columns, F.col("_z.level").alias("_level"), F.col("_z.block").alias("_block"))
    levels = sorted(r["_level"] for r in cut.select("_level").distinct().collect())  # at most LEVELS + 1
    if not levels:
        return points.join(intervals.where("false"), list(keys))
    at = position.cast("bigint")
    sizes = F.array(*[F.struct(F.lit(v).alias("_level"), F.shiftright(at, v).alias("_block")) for v in levels])
    placed = points.where(at.isNotNull()).withColumn("_z", F.explode(sizes)).select(*points.columns, "_z._level", "_z._block")
    return placed.join(cut, [*keys, "_level", "_block"]).drop("_level", "_block")

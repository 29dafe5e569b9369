"""Quantile regression forests (Meinshausen 2006): leaf co-occurrence weights, exact weighted quantiles.

A training row weighs, for a row to predict, the mean over all trees of 1 / leaf size where both
fall into the same leaf. Those weights are never written out: training targets are numbered by
rank, the ranks of each leaf are counted in blocks of 256, block within block, and the quantile
is found by descending from the widest block, one lookup per tree and block level. So a row to
predict meets at most 256 counts per tree and level, however many rows its leaves hold, and rows
that fall into the same leaves are answered once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantile import ranked_values
from ..session import KEY, ensure_checkpoints, stored
from .models import INTERVAL_LEVELS, LEVELS, series_levels, with_levels

# Ranks are told apart eight bits at a time.
BITS = 8
# Sums of shares are compared with a level up to this much, as their order of addition varies.
EPSILON = 1e-9


@dataclass(frozen=True)
class ForestQuantiles:
    """A fitted forest, the block counts of its leaves and the target values by rank."""

    model: PipelineModel
    counts: DataFrame
    values: DataFrame
    rounds: int
    quantiles: Mapping[str, float]
    levels: DataFrame
    overall: tuple[float, float]

    def placed(self, df: DataFrame) -> DataFrame:
        """Add ``_leaves``, the leaf of each tree."""
        return _placed(self.model, with_levels(self.levels, self.overall, df)).drop(*[c for c in LEVELS if c not in df.columns])

    def bounds(self, df: DataFrame) -> DataFrame:
        """Add one column per quantile; nulls among the inputs must have been filled."""
        rows = self.placed(df)
        asked = [F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in self.quantiles.items()]
        state = rows.select("_leaves").distinct().select(
            "_leaves", F.inline(F.array(*asked)), F.lit(0).cast("bigint").alias("_block"), F.lit(0.0).alias("_below"))
        for depth in range(self.rounds):
            state = self._narrowed(state, depth)
        found = state.join(self.values, state["_block"] == self.values["_rank"]).groupBy("_leaves").agg(
            *[F.max(F.when(F.col("name") == n, F.col("_value"))).alias(n) for n in self.quantiles])
        return rows.join(found, "_leaves").drop("_leaves")

    def _narrowed(self, state: DataFrame, depth: int) -> DataFrame:
        """The block of 1/256 that holds the quantile, within each block found so far."""
        held = self.counts.where(F.col("_depth") == depth).select("_tree", "_leaf", "_block", "_parts")
        keys = ["_leaves", "name", "q", "_block", "_below"]
        met = state.select(*keys, F.posexplode("_leaves").alias("_tree", "_leaf")).join(held, ["_tree", "_leaf", "_block"])
        part = F.struct(F.col("_part"), F.col("_share"))
        summed = (
            # Both groupings keep this partitioning.
            met.select(*keys, "_parts").repartition("_leaves", "name")
            .select(*keys, F.inline("_parts"))
            .groupBy(*keys, "_part").agg((F.sum("_share") / F.size("_leaves")).alias("_share"))
            .groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("_all"))
        )
        start = F.struct(F.lit(-1).alias("part"), F.col("_below").alias("below"), F.lit(False).alias("done"))

        def step(acc, x):
            done = acc["done"] | (acc["below"] + x["_share"] >= F.col("q") - EPSILON)
            return F.struct(
                F.when(acc["done"], acc["part"]).otherwise(x["_part"]).alias("part"),
                F.when(done, acc["below"]).otherwise(acc["below"] + x["_share"]).alias("below"),
                done.alias("done"))

        return summed.withColumn("_at", F.aggregate("_all", start, step)).select(
            "_leaves", "name", "q", (F.col("_block") * (1 << BITS) + F.col("_at.part")).alias("_block"), F.col("_at.below").alias("_below"))


def _placed(model: PipelineModel, rows: DataFrame) -> DataFrame:
    placed = model.transform(rows)
    return placed.withColumn("_leaves", vector_to_array("_leaf").cast("array<int>")).drop("_x", "_point", "_leaf")


def fit_forest_quantiles(
    train: DataFrame,
    features: Sequence[str],
    trees: int = 30,
    depth: int = 6,
    smallest: int = 20,
    columns: float = 0.8,
    levels: Mapping[str, float] = INTERVAL_LEVELS,
    target: str = "demand_gw",
    seed: int = 42,
) -> ForestQuantiles:
    """One forest pooled over all series; level and spread of a series are inputs, and each split
    looks at a share ``columns`` of them.

    Every training row counts in every tree, also where the bootstrap left it out. Rows without a
    target are not learned from.
    """
    ensure_checkpoints(train.sparkSession)
    train = train.where(F.col(target).isNotNull())
    scales, overall = series_levels(train.select(KEY, target), target)
    rows = with_levels(scales, overall, train.select(KEY, *features, target))
    forest = RandomForestRegressor(
        featuresCol="_x", labelCol=target, predictionCol="_point", leafCol="_leaf",
        numTrees=trees, maxDepth=depth, minInstancesPerNode=smallest, featureSubsetStrategy=str(columns), seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=[*features, *LEVELS], outputCol="_x"), forest]).fit(rows)

    # Equal targets of a leaf are counted before anything is joined, so a hot value is one row per leaf.
    members = stored(
        _placed(model, rows).select(F.posexplode("_leaves").alias("_tree", "_leaf"), F.col(target).cast("double").alias("_value"))
        .groupBy("_tree", "_leaf", "_value").agg(F.count("*").alias("_count")), "leaf-members")
    alone = train.select(F.col(target).cast("double").alias("_target"))
    values = stored(ranked_values(alone, [], "_target").select("_value", F.col("_before").alias("_rank")), "target-ranks")
    highest = values.agg(F.max("_rank")).head()[0] or 0
    rounds = max(1, -(-int(highest).bit_length() // BITS))

    sizes = members.groupBy("_tree", "_leaf").agg(F.sum("_count").alias("_size"))
    shift = lambda k: F.floor(F.col("_rank") / F.lit(1 << (BITS * k)))
    places = F.array(*[
        F.struct(F.lit(d).alias("_depth"), shift(rounds - d).alias("_block"), F.pmod(shift(rounds - d - 1), F.lit(1 << BITS)).cast("int").alias("_part"))
        for d in range(rounds)])
    counts = (
        members.join(values, "_value").select("_tree", "_leaf", F.inline(places), "_count")
        .groupBy("_tree", "_leaf", "_depth", "_block", "_part").agg(F.sum("_count").alias("_count"))
        .join(sizes, ["_tree", "_leaf"])
        .groupBy("_tree", "_leaf", "_depth", "_block")
        .agg(F.collect_list(F.struct("_part", (F.col("_count") / F.col("_size")).alias("_share"))).alias("_parts")))
    return ForestQuantiles(model, stored(counts, "leaf-blocks"), values, rounds, dict(levels), scales, overall)

"""A fitted tree ensemble as one column expression.

The nodes of all trees are flattened to one literal array; a row walks every tree by array lookups
inside ``aggregate``, on the JVM and without a model transform. So a fitted model can stand wherever
a coefficient model can: in a projection, in the array fold of a recursive forecast, in a request
plan, in a backtest window. The array is part of the model: at most rounds * 2^(depth + 1) nodes.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .features import feature_names
from .models import LEVELS, PooledTrees, with_levels

NODE = "array<struct<feature:int,threshold:double,low:int,high:int,value:double>>"


def node_table(model: PipelineModel) -> DataFrame:
    """(tree, node, feature, threshold, low, high, value) of a pipeline that ends in a boosted model.

    Leaves have feature -1; their values carry the weight of the tree."""
    trees = model.stages[-1]
    spark = SparkSession.active()
    path = scratch(spark, "trees")
    trees.write().save(path)
    weights = F.lit([float(w) for w in trees.treeWeights])
    at = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), at["id"].alias("node"),
        F.when(at["leftChild"] < 0, -1).otherwise(at["split"]["featureIndex"]).alias("feature"),
        F.get(at["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        at["leftChild"].alias("low"), at["rightChild"].alias("high"),
        (at["prediction"] * F.get(weights, F.col("treeID"))).alias("value"))


@dataclass(frozen=True)
class Forest:
    """Trees over named inputs; ``nodes`` are (feature, threshold, low, high, value), children by position."""

    inputs: tuple[str, ...]
    roots: tuple[int, ...]
    nodes: tuple[tuple[int, float, int, int, float], ...]
    depth: int

    @staticmethod
    def of(model: PipelineModel) -> Forest:
        """The trees of a pipeline of an assembler and a boosted model."""
        found: dict[int, dict[int, tuple]] = {}
        for r in node_table(model).collect():  # bounded by the model's own size
            found.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["threshold"] or 0.0, r["low"], r["high"], r["value"])
        return Forest.build(tuple(model.stages[-2].getInputCols()), [found[t] for t in sorted(found)])

    @staticmethod
    def build(inputs: Sequence[str], trees: Sequence[Mapping[int, tuple]]) -> Forest:
        """From one mapping of node ids per tree, each with the root 0."""
        nodes, roots, deepest = [], [], 0
        for tree in trees:
            place = {k: len(nodes) + i for i, k in enumerate(sorted(tree))}
            roots.append(place[0])
            nodes += [(f, float(t), place.get(a, -1), place.get(b, -1), float(v)) for f, t, a, b, v in (tree[k] for k in sorted(tree))]
            level, below = [0], -1
            while level:
                below += 1
                level = [c for k in level if tree[k][0] >= 0 for c in tree[k][2:4]]
            deepest = max(deepest, below)
        return Forest(tuple(inputs), tuple(roots), tuple(nodes), deepest)

    def predict(self, values: Mapping[str, Column]) -> Column:
        """The prediction for named inputs; each input is evaluated once per row."""
        rows = [dict(zip(("feature", "threshold", "low", "high", "value"), n)) for n in self.nodes]
        nodes = F.from_json(F.lit(json.dumps(rows)), NODE)

        def walk(x: Column, root: Column) -> Column:
            def down(at: Column, _: Column) -> Column:
                node = F.get(nodes, at)
                child = F.when(F.get(x, node["feature"]) <= node["threshold"], node["low"]).otherwise(node["high"])
                return F.when(node["feature"] < 0, at).otherwise(child)

            # A tree of one node has nothing to walk.
            return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(max(self.depth, 1))), root, down))["value"]

        def total(x: Column) -> Column:
            return F.aggregate(F.lit(list(self.roots)), F.lit(0.0), lambda sum_, root: sum_ + walk(x, root))

        inputs = F.array(*[values[name].cast("double") for name in self.inputs])
        return F.get(F.transform(F.array(inputs), total), F.lit(0))

    def sql(self, values: Mapping[str, str]) -> str:
        """The same prediction as nested CASE expressions, for checking."""

        def tree(at: int) -> str:
            feature, threshold, low, high, value = self.nodes[at]
            if feature < 0:
                return f"{value!r}::DOUBLE"
            return f"CASE WHEN {values[self.inputs[feature]]} <= {threshold!r} THEN {tree(low)} ELSE {tree(high)} END"

        return "(" + " + ".join(f"({tree(r)})" for r in self.roots) + ")"


@dataclass(frozen=True)
class ForestModel:
    """A forest over serving features, for the recursive plans.

    ``fixed`` are inputs that a request row holds itself, such as the level of its series; ``levels``
    adds them to rows."""

    forest: Forest
    fixed: tuple[str, ...] = ()
    levels: PooledTrees | None = None
    lags: tuple[int, ...] = field(default=(168,))

    @staticmethod
    def of(fitted: PooledTrees) -> ForestModel:
        return ForestModel(Forest.of(fitted.model), LEVELS, fitted)

    def prepared(self, rows: DataFrame) -> DataFrame:
        return rows if self.levels is None else with_levels(self.levels.levels, self.levels.overall, rows)

    def step(self, history: Column, ts: Column, temperature: Column | None = None) -> Column:
        """Prediction of the hour ``ts`` that follows ``history``; a missing input reads 0, as in serving."""
        from .forecast import array_features, serving_scalars

        known = {**serving_scalars(ts, temperature), **array_features(history)}
        named = set(feature_names())
        values = {n: F.coalesce(known[n].cast("double"), F.lit(0.0)) if n in named else known[n] for n in self.forest.inputs if n in known}
        return self.forest.predict(values | {n: F.col(n) for n in self.fixed})


def score_forest(forest: Forest, df: DataFrame) -> DataFrame:
    """Add ``prediction``; nulls among the inputs must have been filled."""
    return df.withColumn("prediction", forest.predict({n: F.col(n) for n in forest.inputs}))

"""Fitted models on Spark ML: pooled boosted trees, leaf quantiles, attributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.buckets import with_positions
from ..operators.quantile import quantiles
from ..operators.rank import tail
from ..session import KEY, ensure_checkpoints, scratch, stored
from .features import build_features

# Levels of the interval models, attribution and context lengths.
INTERVAL_LEVELS = {"lower": 0.10, "median": 0.50, "upper": 0.90}
ATTRIBUTION_ROWS = 3000
CONTEXT_ROWS = 2000
WARM_UP = 168


@dataclass(frozen=True)
class TreeParams:
    """Boosting settings; the three presets follow training, retraining and folds."""

    rounds: int = 800
    depth: int = 6
    step: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    seed: int = 42


TRAINING = TreeParams()
RETRAINING = TreeParams(rounds=700)
FOLDS = TreeParams(rounds=150, depth=5, step=0.08)


@dataclass(frozen=True)
class PooledTrees:
    """A boosted model over all series, and what it knows of each series' level."""

    model: PipelineModel
    levels: DataFrame
    overall: tuple[float, float]


LEVELS = ("_level", "_spread")


def with_levels(levels: DataFrame, overall: tuple[float, float], df: DataFrame) -> DataFrame:
    """Add the training mean and deviation of each row's series; those of all rows for a new series."""
    if LEVELS[0] in df.columns:
        return df
    return df.join(levels, KEY, "left").fillna(dict(zip(LEVELS, overall)))


def _level(target: str) -> tuple[Column, Column]:
    return F.avg(target), F.coalesce(F.stddev(target), F.lit(0.0))


def fold_levels(rows: DataFrame, folds: DataFrame, target: str) -> tuple[DataFrame, dict[int, tuple[float, float]]]:
    """``series_levels`` of every fold's training rows, all folds in one pass.

    ``rows`` hold the ``segment`` of each row; ``folds`` have one row per series and fold, whose training
    rows are those of earlier segments and before its ``_first``. One pair per fold reaches the driver.
    """
    of = folds.select(KEY, F.col("segment").alias("_fold"), "_first")
    seen = rows.join(of, KEY).where((F.col("segment") < F.col("_fold")) & (F.col("ts") < F.col("_first")))
    mean, spread = _level(target)
    levels = stored(seen.groupBy("_fold", KEY).agg(mean.alias("_level"), spread.alias("_spread")), "fold-levels")
    overall = seen.groupBy("_fold").agg(F.coalesce(mean, F.lit(0.0)).alias("_level"), spread.alias("_spread"))
    return levels, {r["_fold"]: (float(r["_level"]), float(r["_spread"])) for r in overall.collect()}


def series_levels(train: DataFrame, target: str) -> tuple[DataFrame, tuple[float, float]]:
    """Per series and over all rows: mean and deviation of the target, combined map-side."""
    mean, spread = _level(target)
    path = scratch(train.sparkSession, "levels")
    train.groupBy(KEY).agg(mean.alias("_level"), spread.alias("_spread")).write.parquet(path)
    overall = train.agg(F.coalesce(mean, F.lit(0.0)), spread).head()
    return train.sparkSession.read.parquet(path), (float(overall[0]), float(overall[1]))


def fit_trees(
    train: DataFrame,
    features: Sequence[str],
    params: TreeParams = TRAINING,
    target: str = "demand_gw",
    bins: int = 32,
    known: tuple[DataFrame, tuple[float, float]] | None = None,
) -> PooledTrees:
    """One boosted model pooled over all series.

    Level and spread of the series are numeric inputs, for any number of series alike;
    ``known`` holds them where a caller has them already. ``bins`` sets how finely every input is cut.
    """
    ensure_checkpoints(train.sparkSession)
    levels, overall = known or series_levels(train.select(KEY, target), target)
    trees = GBTRegressor(
        featuresCol="_x",
        labelCol=target,
        predictionCol="prediction",
        maxIter=params.rounds,
        maxDepth=params.depth,
        stepSize=params.step,
        subsamplingRate=params.rows,
        featureSubsetStrategy=str(params.columns),
        maxBins=bins,
        seed=params.seed,
        checkpointInterval=10,
    )
    rows = with_levels(levels, overall, train.select(KEY, *features, target))
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=[*features, *LEVELS], outputCol="_x"), trees])
    return PooledTrees(pipeline.fit(rows), levels, overall)


def score_trees(fitted: PooledTrees, df: DataFrame) -> DataFrame:
    """Add ``prediction``; nulls among the inputs must have been filled."""
    kept = [] if LEVELS[0] not in df.columns else list(LEVELS)
    scored = fitted.model.transform(with_levels(fitted.levels, fitted.overall, df))
    return scored.drop("_x", *[c for c in LEVELS if c not in kept])


def long_predictions(scored: DataFrame, name: str, target: str = "demand_gw") -> DataFrame:
    return scored.select(KEY, "ts", F.col(target).alias("actual"), F.lit(name).alias("model"), F.col("prediction").alias("pred"))


def feature_importance(fitted: PooledTrees) -> DataFrame:
    """Importance per input, largest first; one row per input, from the model itself."""
    trees, assembler = fitted.model.stages[-1], fitted.model.stages[-2]
    weights = trees.featureImportances.toArray().tolist()
    rows = [(f, i, float(w)) for i, (f, w) in enumerate(zip(assembler.getInputCols(), weights))]
    return SparkSession.active().createDataFrame(rows, "feature string, feature_order int, importance double").orderBy(
        F.col("importance").desc(), "feature_order"
    )


@dataclass(frozen=True)
class LeafQuantiles:
    """A regression tree and the target quantiles of the training rows in each leaf."""

    model: PipelineModel
    leaves: DataFrame
    levels: DataFrame
    overall: tuple[float, float]

    def bounds(self, df: DataFrame) -> DataFrame:
        """Add ``lower``, ``median`` and ``upper``."""
        placed = self.model.transform(with_levels(self.levels, self.overall, df))
        at = placed.drop("_x", "_point", *LEVELS).withColumn("_leaf", F.col("_leaf").cast("int"))
        return at.join(F.broadcast(self.leaves), "_leaf").drop("_leaf")


def fit_leaf_quantiles(
    train: DataFrame,
    features: Sequence[str],
    depth: int = 6,
    levels: Mapping[str, float] = INTERVAL_LEVELS,
    target: str = "demand_gw",
) -> LeafQuantiles:
    """Conditional quantiles in the manner of quantile regression forests (Meinshausen 2006).

    Spark ML has no quantile loss: a tree splits the feature space and the exact
    quantiles of each leaf are taken with the distributed rank. Level and spread of
    the series are inputs, so small series do not get the bounds of large ones.
    """
    ensure_checkpoints(train.sparkSession)
    tree = DecisionTreeRegressor(
        featuresCol="_x", labelCol=target, predictionCol="_point", leafCol="_leaf",
        maxDepth=depth, minInstancesPerNode=20, seed=42,
    )
    scales, overall = series_levels(train.select(KEY, target), target)
    rows = with_levels(scales, overall, train.select(KEY, *features, target))
    model = Pipeline(stages=[VectorAssembler(inputCols=[*features, *LEVELS], outputCol="_x"), tree]).fit(rows)
    placed = model.transform(rows).select(F.col("_leaf").cast("int").alias("_leaf"), target)
    table = quantiles(placed, ["_leaf"], target, list(levels.values()))
    wide = table.groupBy("_leaf").agg(
        *[F.max(F.when(F.col("level") == q, F.col("value"))).alias(name) for name, q in levels.items()]
    )
    # The leaf table is part of the model: at most 2 ** depth rows, fixed once fitted.
    leaves = train.sparkSession.createDataFrame(wide.collect(), wide.schema)
    return LeafQuantiles(model, leaves, scales, overall)


# Attributions of a linear predictor are exact: coefficient times centred feature.


def _centred(df: DataFrame, coefs: Mapping[str, float], rows: int) -> tuple[DataFrame, list[Column]]:
    sample = tail(df.select(KEY, "ts", *coefs), rows).fillna(0, subset=list(coefs))
    means = sample.groupBy(KEY).agg(*[F.avg(f).alias(f"_mean_{f}") for f in coefs])
    joined = sample.join(means, KEY)
    return joined, [(F.lit(float(c)) * (F.col(f) - F.col(f"_mean_{f}"))).alias(f) for f, c in coefs.items()]


def attribution_long(df: DataFrame, coefs: Mapping[str, float], rows: int = ATTRIBUTION_ROWS) -> DataFrame:
    """Signed attribution of every feature for the last rows of each series."""
    joined, parts = _centred(df, coefs, rows)
    return joined.select(KEY, "ts", *parts).unpivot([KEY, "ts"], list(coefs), "feature", "attribution")


def mean_attribution(df: DataFrame, coefs: Mapping[str, float], rows: int = ATTRIBUTION_ROWS) -> DataFrame:
    """Mean absolute attribution per series and feature."""
    joined, parts = _centred(df, coefs, rows)
    wide = joined.select(KEY, *parts).groupBy(KEY).agg(*[F.avg(F.abs(f)).alias(f) for f in coefs])
    order = F.create_map(*[x for i, f in enumerate(coefs) for x in (F.lit(f), F.lit(i))])
    return wide.unpivot([KEY], list(coefs), "feature", "importance").withColumn("feature_order", order[F.col("feature")])


# Rows of one task's share of the random order; a share of one row would have nothing to swap with.
SHARE_ROWS = 2048


def permutation_importance(fitted: PooledTrees, df: DataFrame, features: Sequence[str], target: str = "demand_gw", seed: int = 42) -> DataFrame:
    """Rise in mean squared error when a feature is exchanged between rows.

    Every row takes the feature of the next row in a random order cut into shares, and the last
    row of a share that of its first, so all rows are scored whatever their number. The order is
    a hash of series, time and seed: a retried task repeats it. All features are scored in one plan.
    """
    shares = max(1, df.count() // SHARE_ROWS)
    order = F.xxhash64(KEY, "ts", F.lit(seed))
    share = Window.partitionBy("_part").orderBy("_rand")
    base = df.withColumns({"_rand": order, "_part": F.pmod(F.xxhash64(order, F.lit("share")), F.lit(shares))})
    taken = F.struct(*features)
    whole = share.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = base.withColumn("_swap", F.coalesce(F.lead(taken).over(share), F.first(taken).over(whole)))
    cases = F.array(F.lit(""), *[F.lit(f) for f in features])
    long = base.withColumn("_case", F.explode(cases)).withColumns(
        {f: F.when(F.col("_case") == f, F.col(f"_swap.{f}")).otherwise(F.col(f)) for f in features}
    )
    scored = score_trees(fitted, long.drop("_swap", "_rand", "_part"))
    error = scored.groupBy(F.col("_case").alias("feature")).agg(
        F.avg((F.col(target) - F.col("prediction")) * (F.col(target) - F.col("prediction"))).alias("mse"), F.count("*").alias("rows")
    )
    # One row per feature, so one small window holds them all with the unchanged case.
    every = Window.partitionBy(F.lit(0))
    plain = F.max(F.when(F.col("feature") == "", F.col("mse"))).over(every)
    return error.withColumn("importance", F.col("mse") - plain).where("feature <> ''").select("feature", "importance", "rows")


def context_window(df: DataFrame, rows: int = CONTEXT_ROWS, warm_up: int = WARM_UP) -> DataFrame:
    """Last min(rows, n - warm_up) rows with serving features of the full history."""
    featured = with_positions(build_features(df, policy="serve", holidays="serve"))
    taken = F.least(F.lit(rows), F.col("_n") - warm_up)
    return featured.where(F.col("_pos") >= F.col("_n") - taken).drop("_pos", "_n")

"""Walk-forward folds and the on-demand backtest window."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.buckets import with_positions
from ..operators.metrics import error_metrics
from ..session import KEY, ensure_checkpoints, scratch, stored
from .features import PROFILES, build_features
from .forecast import LinearModel, history_rows, recursive_path
from .linear import linear_prediction, moments, solve
from .models import fold_levels

# Fold geometry, minimum sizes, window limits, summary threshold.
TRAIN_MONTHS = 12
TEST_DAYS = 30
MIN_TRAIN = 500
MIN_TEST = 24
WINDOW_DAYS = (1, 90)
RECURSIVE_HORIZON = 72
MAPE_THRESHOLD = 3.5

# Tasks of a stage of a fold's fit: one per so many rows, and a few at least.
FIT_ROWS = 8192
FIT_TASKS = 8


def _days(n: Column | int) -> Column:
    return F.make_dt_interval(days=n if isinstance(n, Column) else F.lit(n))


def _origins(df: DataFrame, train_months: int) -> DataFrame:
    """First test hour of every series: its start plus the training months."""
    start = F.col("_start")
    whole = F.add_months(start, train_months).cast("timestamp") + (start - F.date_trunc("day", start))
    return (
        df.groupBy(KEY)
        .agg(F.min("ts").alias("_start"), F.max("ts").alias("_end"))
        .withColumn("_origin", whole)
    )


def _segment(test_days: int) -> Column:
    """Index of the test window holding a row; negative before the first one."""
    return F.floor((F.unix_timestamp("ts") - F.unix_timestamp("_origin")) / (test_days * 86400)).cast("int")


def assign_folds(df: DataFrame, train_months: int = TRAIN_MONTHS, test_days: int = TEST_DAYS) -> DataFrame:
    """Add ``segment``: the 0-based test window of each row, -1 for the first training span.

    Test windows are disjoint and equally long, so membership is arithmetic and
    needs no range join.
    """
    origins = _origins(df, train_months)
    return df.join(origins, KEY).withColumn("segment", F.greatest(_segment(test_days), F.lit(-1))).drop(
        "_start", "_end", "_origin"
    )


def fold_table(
    df: DataFrame,
    train_months: int = TRAIN_MONTHS,
    test_days: int = TEST_DAYS,
    min_train: int = MIN_TRAIN,
    min_test: int = MIN_TEST,
    anchored: bool = True,
) -> DataFrame:
    """Folds per series with their sizes; a fold that is too small ends the series.

    ``anchored`` keeps the training start fixed; otherwise the training span
    moves along and stays about ``train_months`` long.
    """
    origins = _origins(df, train_months)
    last = F.floor((F.unix_timestamp("_end") - F.unix_timestamp("_origin")) / (test_days * 86400)).cast("int") - 1
    folds = origins.withColumn("_last", last).where("_last >= 0").select(
        KEY, "_start", "_origin", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("segment")
    )
    shift = _days(F.col("segment") * test_days)
    folds = folds.withColumns({
        "train_start": F.col("_start") if anchored else F.col("_start") + shift,
        "test_start": F.col("_origin") + shift,
    }).withColumn("test_end", F.col("test_start") + _days(test_days))
    segments = assign_folds(df, train_months, test_days)
    sizes = segments.groupBy(KEY, "segment").agg(F.count("*").alias("n_test"))
    # Training size of fold k = rows of all earlier segments: a running sum over a table of folds.
    running = Window.partitionBy(KEY).orderBy("segment")
    spine = folds.select(KEY, "segment").unionByName(origins.select(KEY, F.lit(-1).alias("segment")))
    counted = (
        spine.join(sizes, [KEY, "segment"], "left")
        .fillna(0, subset=["n_test"])
        .withColumn("n_train", F.sum("n_test").over(running) - F.col("n_test"))
    )
    if not anchored:
        gone = _moved_out(df, origins, test_days)
        counted = counted.join(gone, [KEY, "segment"], "left").withColumn(
            "_gone", F.sum(F.coalesce("_gone", F.lit(0))).over(running)
        ).withColumn("n_train", F.col("n_train") - F.col("_gone")).drop("_gone")
    big_enough = (F.col("n_train") >= min_train) & (F.col("n_test") >= min_test)
    return (
        folds.join(counted, [KEY, "segment"])
        .withColumn("_ok", F.min(big_enough.cast("int")).over(running))
        .where("_ok = 1")
        .select(KEY, "segment", (F.col("segment") + 1).alias("fold"), "train_start",
                F.col("test_start").alias("train_end"), "test_start", "test_end", "n_train", "n_test")
    )


def _moved_out(df: DataFrame, origins: DataFrame, test_days: int) -> DataFrame:
    """Rows that leave a moving training span when fold ``segment`` begins."""
    since = F.unix_timestamp("ts") - F.unix_timestamp("_start")
    step = F.floor(since / (test_days * 86400)).cast("int") + 1
    return df.join(origins.select(KEY, "_start"), KEY).groupBy(KEY, step.alias("segment")).agg(F.count("*").alias("_gone"))


def fold_metrics(scored: DataFrame, folds: DataFrame, decimals: int = 4) -> DataFrame:
    """Metrics per fold of rows ``(series_id, segment, actual, pred)``."""
    per = scored.groupBy(KEY, "segment").agg(*error_metrics(F.col("actual"), F.col("pred")))
    out = folds.join(per, [KEY, "segment"])
    for name in ("mae", "rmse", "mape"):
        out = out.withColumn(name, F.round(name, decimals))
    return out.withColumns({c: F.to_date(c) for c in ("train_start", "train_end", "test_start", "test_end")}).drop("segment")


def walk_forward_fixed(predictions: DataFrame, **geometry) -> DataFrame:
    """All folds of a predictor that needs no fitting, in one plan."""
    sizes = {k: geometry[k] for k in ("train_months", "test_days") if k in geometry}
    return fold_metrics(assign_folds(predictions, **sizes), fold_table(predictions, **geometry))


def walk_forward_linear(df: DataFrame, xs: Sequence[str], y: str = "demand_gw", **geometry) -> DataFrame:
    """All folds of a least-squares predictor in one plan.

    An expanding training set is a sum of segments: each segment's moments are
    computed once and accumulated over the folds, so no row is read per fold.
    """
    sizes = {k: geometry[k] for k in ("train_months", "test_days") if k in geometry}
    rows = assign_folds(df, **sizes)
    per_segment = moments(rows, xs, y, (KEY, "segment"))
    length = (len(xs) + 1) * (len(xs) + 2) // 2 + len(xs) + 2
    before = Window.partitionBy(KEY).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    grown = per_segment.select(
        KEY, "segment", F.array(*[F.sum(F.col("moments")[i]).over(before) for i in range(length)]).alias("moments")
    ).where("segment >= 0 AND moments[0] > 0")  # a fold without earlier rows has no fit
    fits = solve(grown, len(xs), (KEY, "segment")).select(KEY, "segment", "coefs")
    scored = rows.join(fits, [KEY, "segment"]).select(
        KEY, "segment", F.col(y).alias("actual"), linear_prediction(xs, F.col("coefs")).alias("pred")
    )
    return fold_metrics(scored, fold_table(df, **geometry))


def walk_forward_model(
    df: DataFrame,
    fit: Callable[..., object],
    score: Callable[[object, DataFrame], DataFrame],
    parallelism: int = 4,
    levels: str | None = None,
    **geometry,
) -> DataFrame:
    """Folds of a fitted model: one pooled fit per fold, several folds at a time.

    ``score`` returns rows with ``actual`` and ``pred``. With ``levels``, a target column, ``fit`` is
    also given the ``fold_levels`` of its fold. The number of folds is small (one per ``test_days``),
    so only their numbers reach the driver. What all folds share (rows, folds, levels) is found once;
    a fold adds the jobs of its fit, and their tasks follow the number of rows.
    """
    sizes = {k: geometry[k] for k in ("train_months", "test_days") if k in geometry}
    base = df.persist()
    folds = stored(fold_table(base, **geometry), "folds")
    starts = folds.groupBy("segment").agg(F.min("test_start").alias("_first"))
    first = {r["segment"]: r["_first"] for r in starts.collect()}
    numbers = sorted(first)
    # The folds of a series are the first ones without a break, so its last one says where it takes part.
    last = folds.groupBy(KEY).agg(F.max("segment").alias("_last"))
    spread = assign_folds(base, **sizes).join(last, KEY).persist()
    tasks = max(FIT_TASKS, spread.count() // FIT_ROWS)
    few = spread.coalesce(tasks) if spread.rdd.getNumPartitions() > tasks else spread
    # Every stage of a fit is sent out with all that its rows derive from; a checkpoint ends that here.
    ensure_checkpoints(df.sparkSession)
    rows = few.checkpoint()
    spread.unpersist()
    base.unpersist()
    known = {}
    if levels is not None:
        table, overall = fold_levels(rows, folds.join(starts, "segment"), levels)
        known = {k: (table.where(F.col("_fold") == k).drop("_fold"), overall.get(k, (0.0, 0.0))) for k in numbers}

    def one(k: int) -> DataFrame:
        alive = rows.where(F.col("_last") >= k).drop("_last")
        # One model serves all series: nothing from after the earliest test start may reach it.
        train = alive.where((F.col("segment") < k) & (F.col("ts") < F.lit(first[k])))
        test = alive.where(F.col("segment") == k)
        fitted = fit(train, known[k]) if known else fit(train)
        return score(fitted, test).select(KEY, "segment", "actual", "pred")

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, numbers))
    scored = rows.where("false").select(KEY, "segment", F.lit(0.0).alias("actual"), F.lit(0.0).alias("pred"))
    for part in parts:
        scored = scored.unionByName(part)
    path = scratch(df.sparkSession, "fold-scores")
    scored.write.parquet(path)
    out = df.sparkSession.read.schema(scored.schema).parquet(path)
    return fold_metrics(out, folds)


def summarize_folds(folds: DataFrame, threshold: float = MAPE_THRESHOLD) -> DataFrame:
    """Fold count, mean metrics, MAPE range and how many folds beat the threshold and the average."""
    mean = folds.groupBy(KEY).agg(F.avg("mape").alias("_mean"))
    return folds.join(mean, KEY).groupBy(KEY).agg(
        F.count("*").alias("folds"),
        F.avg("mae").alias("avg_mae"),
        F.avg("rmse").alias("avg_rmse"),
        F.avg("mape").alias("avg_mape"),
        F.min("mape").alias("min_mape"),
        F.max("mape").alias("max_mape"),
        F.count_if(F.col("mape") < threshold).alias("under_threshold"),
        F.count_if(F.col("mape") >= threshold).alias("over_threshold"),
        F.count_if(F.col("mape") < F.col("_mean")).alias("under_average"),
    )


# On-demand window


def clamp_window(days: int) -> int:
    """Days as a request step may limit them; the windows below take any number."""
    return min(max(days, WINDOW_DAYS[0]), WINDOW_DAYS[1])


def oracle_window(df: DataFrame, days: int, predict: Callable[[DataFrame], Column | DataFrame], temperature: str = "proxy") -> DataFrame:
    """Last ``days`` days scored with lags of actual values.

    Series shorter than the window plus a week are left out. ``temperature``
    chooses the seasonal proxy (as served) or the stored values.
    """
    n = days * 24
    base = df
    if temperature == "proxy":
        from ..functions.weather import synthetic_temperature

        base = df.withColumn("temperature_f", synthetic_temperature(F.col("ts"), None))
    rows = with_positions(build_features(base, policy="serve", holidays="serve"))
    window = rows.where((F.col("_pos") >= F.col("_n") - n) & (F.col("_n") >= n + 168)).drop("_pos", "_n")
    pred = predict(window)
    scored = window.withColumn("pred", pred) if isinstance(pred, Column) else pred
    return scored.select(KEY, "ts", F.col("demand_gw").alias("actual"), "pred")


def recursive_window(df: DataFrame, days: int, model: LinearModel, reanchor_hours: int | None = None) -> DataFrame:
    """The same window with predictions written back as lags.

    By default the recursion runs through the whole window. ``reanchor_hours``
    restarts it from actual values every so many hours. Each restart needs the rows
    before it that the model reads, so a row is copied to a bounded number of them.
    """
    n = days * 24
    history = history_rows(model)
    chunk = n if reanchor_hours is None else reanchor_hours
    rows = with_positions(df.select(KEY, "ts", "demand_gw")).where(F.col("_n") >= n + 168)
    first = F.col("_n") - n
    # Restart c covers positions [first + c * chunk, first + (c + 1) * chunk).
    into = F.col("_pos") - first
    low = F.greatest(F.floor(into / chunk), F.lit(0))
    high = F.least(F.floor((into + history) / chunk), F.lit((n - 1) // chunk))
    spread = rows.where(into >= -history).withColumn("_into", into).withColumn(
        "_chunk", F.explode(F.when(low <= high, F.sequence(low, high)))
    )
    item = F.struct("_into", "ts", "demand_gw")
    packed = spread.groupBy(KEY, "_chunk").agg(F.array_sort(F.collect_list(item)).alias("_rows")).withColumns({
        "_past": F.filter("_rows", lambda r: r["_into"] < F.col("_chunk") * chunk),
        "_test": F.filter("_rows", lambda r: r["_into"] >= F.col("_chunk") * chunk),
    })
    packed = model.prepared(packed)
    path = recursive_path(F.col("_past.demand_gw"), F.col("_test")[0]["ts"], F.size("_test"), model)
    zipped = F.arrays_zip(F.col("_test.ts").alias("ts"), F.col("_test.demand_gw").alias("actual"), path.alias("pred"))
    return packed.select(KEY, F.explode(zipped).alias("_z")).select(KEY, "_z.ts", "_z.actual", "_z.pred")


def window_metrics(scored: DataFrame) -> DataFrame:
    """Served metrics: errors rounded to 3 decimals, percentage over all rows."""
    from ..operators.metrics import mape_all_rows

    rounded = scored.select(KEY, F.round("actual", 3).alias("actual"), F.round("pred", 3).alias("pred"))
    actual, pred = F.col("actual"), F.col("pred")
    return rounded.groupBy(KEY).agg(
        F.count("*").alias("n_points"),
        F.round(F.avg(F.abs(pred - actual)), 3).alias("mae_gw"),
        F.round(mape_all_rows(actual, pred), 2).alias("mape_pct"),
        F.round(F.sqrt(F.avg((pred - actual) * (pred - actual))), 3).alias("rmse_gw"),
    )

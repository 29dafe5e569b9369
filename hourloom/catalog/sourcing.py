"""Sources, sinks and the run registry; file round trips go through the shared folder."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.weather import synthetic_temperature
from ..operators import clean
from ..operators.metrics import metrics_by_model
from ..operators.rank import tail
from ..plans.features import lag_columns
from ..schemas import DEMAND, LOAD_PAGE
from ..session import scratch
from ..sources import pages, registry, tables
from . import series as S
from .core import cte, query

CANONICAL = "series_id ts:t demand_gw:f temperature_f:f"


@query("src_demand_csv", CANONICAL, "SELECT * FROM canonical", "canonical")
def _(spark, sf):
    path = scratch(spark, "demand-csv")
    tables.write_csv(S.canonical(spark, sf).select(*DEMAND.fieldNames()), path)
    return tables.read_demand_csv(spark, path)


@query("src_load_json", "series_id period gw:f", """
SELECT series_id, strftime(ts, '%Y-%m-%dT%H') AS period, demand_gw AS gw FROM hourly""", "hourly")
def _(spark, sf):
    path = scratch(spark, "load-pages")
    pages.load_pages(S.hourly(spark, sf), F.round(F.col("demand_gw") * 1000).cast("bigint")).write.json(path)
    return pages.read_load_pages(spark, path).withColumn("gw", clean.mega_to_giga(F.col("value")))


REPORT = "series_id total:i n_pages:i n_rows:i missing_rows:i repeated_rows:i repeated_pages:i shifted_pages:i first_empty:i complete"
cte("landed", """
SELECT series_id, k, n, sum(n) OVER (PARTITION BY series_id) AS total, sum(n) OVER (PARTITION BY series_id ORDER BY k) - n AS first
FROM (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY p) - 1 AS k, n FROM (
  SELECT series_id, CAST(floor(epoch(ts) / 3600 / 100) AS BIGINT) AS p, count(*) AS n FROM hourly GROUP BY 1, 2))""", "hourly")


@query("src_load_reconcile", REPORT, """
SELECT series_id, max(total) AS total, count(*) AS n_pages, sum(n) FILTER (k <> 2) + coalesce(max(n) FILTER (k = 1), 0) AS n_rows,
  coalesce(max(n) FILTER (k = 2), 0) AS missing_rows, coalesce(max(n) FILTER (k = 1), 0) AS repeated_rows, count(*) FILTER (k = 1) AS repeated_pages,
  0 AS shifted_pages, max(total) AS first_empty, CAST(coalesce(max(n) FILTER (k = 2), 0) = 0 AS VARCHAR) AS complete
FROM (SELECT series_id, k, n, total FROM landed UNION ALL SELECT DISTINCT series_id, -1, 0, total FROM landed) GROUP BY 1
""".replace("count(*) AS n_pages", "count(*) FILTER (k <> 2) + count(*) FILTER (k = 1) AS n_pages"), "landed")
def _(spark, sf):
    """Pages of 100 hours, of which the third is lost and the second landed twice, up to an empty one."""
    from pyspark.sql import Window

    path = scratch(spark, "reconciled-pages")
    landed = pages.load_pages(S.hourly(spark, sf), F.round(F.col("demand_gw") * 1000).cast("bigint"), page_size=100)
    numbered = landed.withColumn("_k", F.row_number().over(Window.partitionBy("series_id").orderBy("offset")) - 1)
    empty = landed.groupBy("series_id").agg(F.max(F.col("response.total")).alias("total")).select(
        "series_id", F.col("total").cast("bigint").alias("offset"), F.struct("total", F.array().cast(landed.schema["response"].dataType["data"].dataType).alias("data")).alias("response"))
    kept = numbered.where("_k <> 2").unionByName(numbered.where("_k = 1")).drop("_k")
    kept.unionByName(empty).write.json(path)
    report = pages.reconcile_pages(spark.read.schema(LOAD_PAGE).json(path))
    return report.withColumn("complete", F.col("complete").cast("string"))


@query("src_load_increment", "series_id ts:t demand_gw:f fallback:i", """
SELECT series_id, ts, demand_gw, 0 AS fallback FROM hourly WHERE ts > TIMESTAMP '2024-01-15' AND demand_gw <= 1000
UNION ALL SELECT series_id, ts, demand_gw, 1 FROM hourly WHERE ts > TIMESTAMP '2024-01-15'""", "hourly")
def _(spark, sf):
    stored = S.hourly(spark, sf)
    path = scratch(spark, "increment-pages")
    # Null values stand for hours the service has not measured yet.
    mwh = F.when(F.col("demand_gw") <= 1000, F.round(F.col("demand_gw") * 1000).cast("bigint"))
    pages.load_pages(stored, mwh).write.json(path)
    since = F.lit("2024-01-15").cast("timestamp")
    fetched = pages.load_increment(pages.read_load_pages(spark, path), stored, since)
    fallback = pages.load_increment(None, stored, since)
    return fetched.withColumn("fallback", F.lit(0)).unionByName(fallback.withColumn("fallback", F.lit(1)))


@query("src_weather_json", "ts:t temperature_f:f days:i", """
SELECT ts, temperature_f, least(16, greatest(1, CAST(floor(temperature_f / 4) AS BIGINT))) AS days FROM archive""", "archive")
def _(spark, sf):
    path = scratch(spark, "weather-pages")
    pages.weather_pages(S.temperature(spark, sf, "view")).write.json(path)
    rows = pages.read_weather_pages(spark, path)
    return rows.withColumn("days", pages.clamp_days(F.floor(F.col("temperature_f") / 4)))


@query("src_predictions_csv", "series_id ts:t actual:f model pred:f lower_gw:f upper_gw:f", """
SELECT series_id, ts, actual, model, pred, CASE WHEN model = 'naive_day' THEN pred - 1 END AS lower_gw,
       CASE WHEN model = 'naive_day' THEN pred + 1 END AS upper_gw FROM predictions""", "predictions")
def _(spark, sf):
    wide = S.predictions(spark, sf).withColumnRenamed("ts", "timestamp")
    day, week, none = (scratch(spark, n) for n in ("day", "week", "none"))
    first = wide.where("model = 'naive_day'").select(
        "series_id", "timestamp", F.col("actual").alias("demand_gw"), F.col("pred").alias("trees_pred"),
        (F.col("pred") - 1).alias("lower_gw"), (F.col("pred") + 1).alias("upper_gw"))
    second = wide.where("model = 'naive_week'").select(
        "series_id", "timestamp", (F.col("actual") * 1000).alias("demand_mw"), F.col("pred").alias("seasonal_pred"))
    tables.write_csv(first, day)
    tables.write_csv(second, week)
    tables.write_csv(second.drop("seasonal_pred"), none)
    return tables.read_predictions(spark, {
        "naive_day": (day, "trees_pred"), "naive_week": (week, "seasonal_pred"), "absent": (none, "context_pred")})


@query("src_time_grid", "series_id ts:t", """
SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY 1""", "hourly")
def _(spark, sf):
    span = S.hourly(spark, sf).groupBy("series_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return clean.time_grid(span, "start", "end")


@query("snk_table", CANONICAL, "SELECT * FROM canonical", "canonical")
def _(spark, sf):
    path = scratch(spark, "canonical")
    tables.write_table(S.canonical(spark, sf), path)
    return tables.read_demand(spark, path)


@query("snk_forecast", "series_id ts:t pred:f run_ts:t", """
SELECT series_id, ts, pred, TIMESTAMP '2024-02-01 00:00:00' AS run_ts FROM predictions WHERE model = 'naive_day'
UNION ALL SELECT series_id, ts, pred, TIMESTAMP '2024-02-01 01:00:00' FROM predictions WHERE model = 'naive_week'
""", "predictions")
def _(spark, sf):
    path = scratch(spark, "forecasts")
    points = S.predictions(spark, sf)
    for model, run in (("naive_day", "2024-02-01 00:00:00"), ("naive_week", "2024-02-01 01:00:00")):
        tables.append_forecast(points.where(F.col("model") == model).select("series_id", "ts", "pred"), path, run)
    return spark.read.parquet(path)


@query("snk_seed", "series_id ts:t demand_gw:f", """
SELECT series_id, ts, demand_gw FROM filled
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 200""", "filled")
def _(spark, sf):
    path = scratch(spark, "seed")
    tail(S.filled(spark, sf), 200).write.parquet(path)
    return spark.read.parquet(path)


RUN_TS = "2024-02-01 00:00:00"


def _runs(spark, sf):
    """One run per series and model, from the metrics of the naive predictions."""
    scored = metrics_by_model(S.predictions(spark, sf))
    last = S.hourly(spark, sf).groupBy("series_id").agg(F.max("ts").alias("last_ts"))
    return registry.run_records(
        scored.join(last, "series_id"),
        run_name=F.concat_ws("_", "model", "series_id"),
        experiment="demand",
        start_time=F.lit(RUN_TS),
        params=F.create_map(F.lit("feature_count"), F.lit("32"),
                            F.lit("last_training_ts"), F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss")),
        metrics=F.create_map(*[x for m in ("mae", "rmse", "mape") for x in (F.lit(m), F.col(m))]),
        tags=F.create_map(F.lit("model"), F.col("model")),
    )


METRICS = """SELECT series_id, model, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) * (actual - pred))) AS rmse,
       avg(CASE WHEN actual <> 0 THEN abs((actual - pred) / actual) END) * 100 AS mape
FROM predictions GROUP BY 1, 2"""
cte("model_metrics", METRICS, "predictions")
cte("runs", f"""
SELECT substr(md5(model || '_' || m.series_id || '{RUN_TS}'), 1, 8) AS run_id, model || '_' || m.series_id AS run_name,
       model, mae, rmse, mape, last_ts
FROM model_metrics m JOIN (SELECT series_id, max(ts) AS last_ts FROM hourly GROUP BY 1) l
  ON m.series_id = l.series_id""", "model_metrics", "hourly")


@query("registry_log", "run_id run_name experiment start_time:t status feature_count mape:f model n_artifacts:i", f"""
SELECT *, 'demand' AS experiment, TIMESTAMP '{RUN_TS}' AS start_time, 'FINISHED' AS status, '32' AS feature_count,
       0 AS n_artifacts FROM runs""", "runs")
def _(spark, sf):
    return _runs(spark, sf).select(
        "*", F.col("params")["feature_count"].alias("feature_count"), F.col("metrics")["mape"].alias("mape"),
        F.col("tags")["model"].alias("model"), F.size("artifacts").alias("n_artifacts"))


def _stored_runs(spark, sf):
    path = scratch(spark, "runs")
    registry.log_runs(_runs(spark, sf), path)
    return registry.load_runs(spark, path)


@query("registry_load", "run_id run_name score:f rank:i", """
SELECT run_id, run_name, mape AS score, row_number() OVER (ORDER BY mape, run_name, run_id) AS rank FROM runs""", "runs")
def _(spark, sf):
    return registry.leaderboard(_stored_runs(spark, sf))


@query("registry_current", "model loaded run_id feature_count:i last_training_date:d mape:f mae:f", """
SELECT model, TRUE AS loaded, run_id, 32 AS feature_count, CAST(last_ts AS DATE) AS last_training_date, mape, mae
FROM runs QUALIFY row_number() OVER (PARTITION BY model ORDER BY run_id DESC) = 1""", "runs")
def _(spark, sf):
    return registry.current_models(_stored_runs(spark, sf))


@query("model_save_load", "series_id ts:t prediction:f")
def _(spark, sf):
    from ..operators.buckets import drop_halo, halo_window, with_halo

    rows = drop_halo(with_halo(S.filled(spark, sf), 168).withColumns(
        lag_columns("demand_gw", [1, 24, 168], halo_window()))).dropna()
    inputs = ["demand_lag_1h", "demand_lag_24h", "demand_lag_168h"]
    model = Pipeline(stages=[
        VectorAssembler(inputCols=inputs, outputCol="x"),
        LinearRegression(featuresCol="x", labelCol="demand_gw", solver="normal"),
    ]).fit(rows)
    path = scratch(spark, "model")
    registry.save_model(model, path)
    return registry.load_model(spark, path + "-missing", path).transform(rows)

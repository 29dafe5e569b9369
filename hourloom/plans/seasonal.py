"""Seasonal ARIMA (1,1,1)(1,1,1,7) on daily series by two regressions.

Hannan and Rissanen (1982): residuals of a long autoregression stand in for the
unobserved shocks, then the differenced series is regressed on its own lags and
on lagged residuals. This approximates a likelihood fit; the coefficients of the
product lags are left free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.buckets import KEYS, drop_halo, halo_window, with_halo
from ..operators.rank import tail
from ..session import KEY, stored
from .linear import fit_ols, linear_prediction

# Differencing lags and model lags of (1,1,1)(1,1,1,7).
DIFF_LAGS = (1, 7, 8)
MODEL_LAGS = (1, 7, 8)
LONG_AR = 14


def day_index(ts: str = "ts") -> Column:
    return F.floor(F.unix_timestamp(ts) / 86400)


def seasonal_diff(daily: DataFrame, value: str = "demand_gw") -> DataFrame:
    """Add ``w`` = (1 - B)(1 - B^7) of a daily series without missing days."""
    w = halo_window()
    lag = lambda k: F.lag(value, k).over(w)
    rows = with_halo(daily, max(DIFF_LAGS), day_index())
    return drop_halo(rows.withColumn("w", F.col(value) - lag(1) - lag(7) + lag(8)))


def _with_lags(df: DataFrame, column: str, lags) -> DataFrame:
    w = halo_window()
    rows = with_halo(df, max(lags), day_index())
    return drop_halo(rows.withColumns({f"{column}_{k}": F.lag(column, k).over(w) for k in lags}))


def _residual(df: DataFrame, xs, fit: DataFrame, out: str) -> DataFrame:
    joined = df.join(fit.select(KEY, "coefs"), KEY)
    return joined.withColumn(out, F.col("w") - linear_prediction(xs, F.col("coefs"))).drop("coefs")


def _stage_rows(daily: DataFrame) -> DataFrame:
    """Differenced rows with long-AR residuals ``e`` and the model lags of both."""
    long_lags = range(1, LONG_AR + 1)
    xs = [f"w_{k}" for k in long_lags]
    diffed = _with_lags(seasonal_diff(daily), "w", list(long_lags))
    with_e = _residual(diffed, xs, fit_ols(diffed, xs, "w"), "e")
    keep = [KEY, "ts", "demand_gw", "w", "e", *[f"w_{k}" for k in MODEL_LAGS]]
    return _with_lags(with_e.select(*keep), "e", list(MODEL_LAGS))


MODEL_COLUMNS = [f"w_{k}" for k in MODEL_LAGS] + [f"e_{k}" for k in MODEL_LAGS]


def fit_seasonal(daily: DataFrame) -> DataFrame:
    """Coefficients, residual variance, AIC and BIC per series."""
    return _fit_stage(_stage_rows(daily))


def _fit_stage(rows: DataFrame) -> DataFrame:
    fit = fit_ols(rows, MODEL_COLUMNS, "w")
    k = len(MODEL_COLUMNS) + 2
    n = F.col("n")
    deviance = n * (F.log(F.lit(6.283185307179586) * F.col("rss") / n) + 1)
    return fit.withColumns({
        "sigma2": F.col("rss") / n,
        "aic": deviance + 2 * k,
        "bic": deviance + F.log(n) * k,
    })


def forecast_seasonal(daily: DataFrame, steps: int, fit: DataFrame | None = None) -> DataFrame:
    """``steps`` daily forecasts per series; future shocks are zero."""
    rows = stored(_stage_rows(daily), "stage-rows")  # read by the fit and by the last days
    fit = _fit_stage(rows) if fit is None else fit
    depth = max(MODEL_LAGS)
    last = (
        tail(rows, depth)
        .groupBy(KEY)
        .agg(F.array_sort(F.collect_list(F.struct("ts", "demand_gw", "w", "e"))).alias("_last"))
        .where(F.size("_last") == depth)
    )
    state = last.join(fit.select(KEY, "coefs"), KEY).select(
        KEY,
        "coefs",
        F.element_at("_last", -1)["ts"].alias("_end"),
        F.struct(
            F.col("_last.demand_gw").alias("y"),
            F.col("_last.w").alias("w"),
            F.transform(F.col("_last.e"), lambda e: F.coalesce(e, F.lit(0.0))).alias("e"),
        ).alias("_state"),
    )

    def step(acc: Column, _: Column) -> Column:
        back = lambda name, k: F.element_at(acc[name], -k)
        w = F.col("coefs")[0]
        for i, k in enumerate(MODEL_LAGS, start=1):
            w = w + F.col("coefs")[i] * back("w", k) + F.col("coefs")[i + len(MODEL_LAGS)] * back("e", k)
        y = w + back("y", 1) + back("y", 7) - back("y", 8)
        return F.struct(
            F.concat(acc["y"], F.array(y)).alias("y"),
            F.concat(acc["w"], F.array(w)).alias("w"),
            F.concat(acc["e"], F.array(F.lit(0.0))).alias("e"),
        )

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("_state"), step, lambda acc: F.slice(acc["y"], depth + 1, steps))
    return state.select(KEY, "_end", F.posexplode(path).alias("_i", "pred")).select(
        KEY, (F.col("_end") + F.make_dt_interval(days=F.col("_i") + 1)).alias("ts"), "pred"
    )

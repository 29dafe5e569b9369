"""Feature tables: one shuffle and one sort for all lags and rolling windows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, cyclic_columns, growth_proxy
from ..functions.weather import degree_columns
from ..operators.buckets import KEYS, drop_halo, halo_window, with_halo, with_positions

# The lags, windows and column sets of the two profiles.
PROFILES = {
    "full": {
        "calendar": ["hour", "dayofweek", "month", "dayofyear", "weekofyear", "quarter", "is_weekend", "is_holiday"],
        "cycles": ("hour", "dow", "month", "dayofyear"),
        "lags": [1, 2, 3, 6, 12, 24, 48, 72, 168],
        "rolls": {"mean_24h": "demand_roll_mean_24h", "std_24h": "demand_roll_std_24h", "mean_168h": "demand_roll_mean_168h"},
        "holidays": "train",
    },
    "backtest": {
        "calendar": ["hour", "dayofweek", "month", "dayofyear", "is_weekend", "is_holiday"],
        "cycles": ("hour", "dow", "month"),
        "lags": [1, 2, 24, 48, 168],
        "rolls": {"mean_24h": "roll_mean_24h", "std_24h": "roll_std_24h", "mean_168h": "roll_mean_168h"},
        "holidays": "backtest",
    },
}
REACH = 168
DAY, WEEK = 24, 168


def feature_names(profile: str = "full", with_temperature: bool = True) -> list[str]:
    """Feature columns in table order: 32 for ``full``, 24 for ``backtest``."""
    p = PROFILES[profile]
    names = list(p["calendar"])
    names += [f"{c}_{f}" for c in p["cycles"] for f in ("sin", "cos")]
    if with_temperature or profile == "full":
        names += ["temp_sq", "temp_cooling", "temp_heating"]
    names += [f"demand_lag_{k}h" for k in p["lags"]]
    names += list(p["rolls"].values())
    return names + ["data_center_load_gw"]


def temperature_column(df: DataFrame) -> Column | None:
    """``temperature_f`` if present, else ``temp_f``, else none."""
    for name in ("temperature_f", "temp_f"):
        if name in df.columns:
            return F.col(name)
    return None


def _temperature_features(df: DataFrame, profile: str) -> dict[str, Column]:
    temp = temperature_column(df)
    if temp is not None:
        return degree_columns(temp)
    if profile == "full":
        return {name: F.lit(0.0) for name in ("temp_sq", "temp_cooling", "temp_heating")}
    return {}


def lag_columns(value: str, lags, w, clamp: bool = False) -> dict[str, Column]:
    """Row lags; ``clamp`` reads the first value of the series before its start."""
    out = {}
    for k in lags:
        lagged = F.lag(value, k).over(w)
        if clamp:
            lagged = F.coalesce(lagged, F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        out[f"demand_lag_{k}h"] = lagged
    return out


def with_day(df: DataFrame, value: str, w) -> DataFrame:
    """Add sum, count and deviation of the 24 rows before each row, for ``roll_columns``.

    ``w`` is a ``halo_window``. A later window of the same order needs no sort of its own.
    """
    day = w.rowsBetween(-DAY, -1)
    return df.withColumns({
        "_day_sum": F.sum(value).over(day),
        "_day_n": F.count(value).over(day),
        "_day_std": F.stddev_samp(value).over(day),
    })


def roll_columns(w, partial: bool = False) -> dict[str, Column]:
    """Trailing mean and deviation of the rows before the current one, on rows of ``with_day``.

    Full windows only, unless ``partial``: then frames are clipped at the series
    start, an empty mean is 0 and a deviation of fewer than two rows is 0.
    A week is the days that end here and 24, 48, ... rows before: seven terms a
    row instead of a frame of 168.
    """
    def week(day: Column, missing: Column | None = None) -> Column:
        days = [day] + [F.lag(day, k).over(w) for k in range(DAY, WEEK, DAY)]
        return reduce(add, days if missing is None else [F.coalesce(d, missing) for d in days])

    total, n, std = F.col("_day_sum"), F.col("_day_n"), F.col("_day_std")
    if not partial:
        whole = n == DAY
        # Null unless every row exists and holds a value; so is a sum with such a day.
        total = F.when(whole, total)
        return {"mean_24h": total / DAY, "std_24h": F.when(whole, std), "mean_168h": week(total) / WEEK}
    zero = F.lit(0.0)
    rolls = {
        "mean_24h": F.try_divide(total, n),
        "std_24h": std,
        "mean_168h": F.try_divide(week(total, zero), week(n, F.lit(0))),
    }
    return {name: F.coalesce(expr, zero) for name, expr in rolls.items()}


def build_features(
    df: DataFrame,
    profile: str = "full",
    holidays: str | None = None,
    policy: str = "train",
    by_row: bool = False,
    keep_incomplete: bool = False,
    keys=KEYS,
) -> DataFrame:
    """Feature table of ``(series_id, ts, demand_gw[, temperature_f])``.

    ``policy="train"`` needs full windows and drops rows with any null;
    ``policy="serve"`` clamps lags and clips windows at the series start.
    Rows are placed by hour, which is exact for gap-filled series; ``by_row``
    numbers the rows first, for series whose hours may be missing.
    """
    p = PROFILES[profile]
    ts = F.col("ts")
    serve = policy == "serve"
    base = with_positions(df, keys) if by_row else df
    spread = with_halo(base, REACH, F.col("_pos") if by_row else None)
    w = halo_window(keys)
    windows = lag_columns("demand_gw", p["lags"], w, clamp=serve)
    windows |= {p["rolls"][k]: v for k, v in roll_columns(w, partial=serve).items()}
    rows = drop_halo(with_day(spread, "demand_gw", w).withColumns(windows))
    if not (serve or keep_incomplete):
        # What follows from these is null with them only, so the rest need not be looked at.
        rows = rows.dropna(subset=[*df.columns, *windows])
    scalars = {k: v for k, v in calendar_columns(ts, holidays or p["holidays"]).items() if k in p["calendar"]}
    scalars |= cyclic_columns(ts, p["cycles"])
    scalars |= _temperature_features(df, profile)
    scalars["data_center_load_gw"] = growth_proxy(ts)
    names = feature_names(profile, temperature_column(df) is not None)
    return rows.withColumns(scalars).select(*df.columns, *names)

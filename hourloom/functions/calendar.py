"""Calendar, holiday, cyclic and trend columns of a timestamp."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Holiday dates the training, backtest and serving features use,
# and the fixed month-day list of the structural load model.
TRAIN_HOLIDAYS = [
    "2022-01-17", "2022-02-21", "2022-05-30", "2022-07-04",
    "2022-09-05", "2022-11-24", "2022-12-26",
    "2023-01-02", "2023-01-16", "2023-02-20", "2023-05-29", "2023-07-04",
    "2023-09-04", "2023-11-23", "2023-12-25",
    "2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27",
    "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25",
]
BACKTEST_HOLIDAYS = [
    "2022-01-17", "2022-05-30", "2022-07-04", "2022-09-05", "2022-11-24", "2022-12-26",
    "2023-01-02", "2023-05-29", "2023-07-04", "2023-09-04", "2023-11-23", "2023-12-25",
    "2024-01-01", "2024-05-27", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25",
]
SERVE_HOLIDAYS = TRAIN_HOLIDAYS + [
    "2025-01-01", "2025-01-20", "2025-02-17", "2025-05-26",
    "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-05-25",
    "2026-07-04", "2026-09-07", "2026-11-26", "2026-12-25",
]
FIXED_MONTH_DAYS = [(1, 1), (7, 4), (11, 11), (12, 25), (12, 31)]

HOLIDAYS = {
    "train": TRAIN_HOLIDAYS,
    "backtest": BACKTEST_HOLIDAYS,
    "serve": SERVE_HOLIDAYS,
}

# Cycle lengths of the sine and cosine encodings.
CYCLES = {"hour": 24, "dow": 7, "month": 12, "dayofyear": 365}

# Fixed value: origin of the linear growth proxy.
GROWTH_ORIGIN = "2022-01-01"


def is_holiday(ts: Column, profile: str = "train") -> Column:
    """1 on a holiday of the profile, else 0; ``fixed`` uses month and day only."""
    if profile == "fixed":
        codes = [m * 100 + d for m, d in FIXED_MONTH_DAYS]
        return (F.month(ts) * 100 + F.dayofmonth(ts)).isin(codes).cast("int")
    days = [date.fromisoformat(d) for d in HOLIDAYS[profile]]
    return ts.cast("timestamp").cast("date").isin(days).cast("int")


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def calendar_columns(ts: Column, holidays: str = "train") -> dict[str, Column]:
    """Integer calendar columns; weekdays count from Monday = 0."""
    return {
        "hour": F.hour(ts),
        "dayofweek": F.weekday(ts),
        "month": F.month(ts),
        "dayofyear": F.dayofyear(ts),
        "weekofyear": F.weekofyear(ts),
        "quarter": F.quarter(ts),
        "is_weekend": is_weekend(ts),
        "is_holiday": is_holiday(ts, holidays),
    }


def cyclic_columns(ts: Column, names: tuple[str, ...] = tuple(CYCLES)) -> dict[str, Column]:
    part = {"hour": F.hour(ts), "dow": F.weekday(ts), "month": F.month(ts), "dayofyear": F.dayofyear(ts)}
    out = {}
    for name in names:
        angle = part[name] * F.lit(2 * math.pi) / F.lit(CYCLES[name])
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def growth_proxy(ts: Column) -> Column:
    """2 GW at the origin, rising 0.75 GW per 365 days, stepping once a day."""
    return F.lit(2.0) + F.datediff(ts, F.lit(GROWTH_ORIGIN).cast("date")) / F.lit(365) * F.lit(0.75)

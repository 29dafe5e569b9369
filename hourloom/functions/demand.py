"""Deterministic load shape used as a baseline predictor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import is_holiday, is_weekend
from .weather import hvac_load


def daily_curve(hour: Column) -> Column:
    """Hour-of-day load factor: night, morning ramp, plateau, evening peak, decline."""
    return (
        F.when(hour < 6, F.lit(0.55))
        .when(hour < 9, (hour - 6) / 3 * 0.30 + 0.55)
        .when(hour < 17, F.lit(0.85))
        .when(hour < 21, (hour - 17) / 4 * 0.15 + 0.85)
        .otherwise(F.lit(1.0) - (hour - 21) / 3 * 0.45)
    )


def structural_load(ts: Column, start: Column, temp: Column) -> Column:
    """Base, growth, daily cycle and weather load, damped on weekends and holidays."""
    years = (F.unix_timestamp(ts) - F.unix_timestamp(start)) / F.lit(365.25 * 24 * 3600)
    growth = (F.pow(F.lit(1.08), years) - 1) * (25.0 * 0.15)
    load = F.lit(25.0) + growth + daily_curve(F.hour(ts)) * 18.0 + hvac_load(temp)
    damped = (
        load
        * F.when(is_weekend(ts) == 1, 0.85).otherwise(1.0)
        * F.when(is_holiday(ts, "fixed") == 1, 0.78).otherwise(1.0)
    )
    return F.greatest(damped, F.lit(10.0))

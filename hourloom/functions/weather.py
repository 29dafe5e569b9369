"""Temperature columns: seasonal proxy and degree terms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import half_even


def synthetic_temperature(ts: Column, decimals: int | None = 1) -> Column:
    """Seasonal plus diurnal proxy in Fahrenheit; ``decimals=None`` leaves it unrounded."""
    season = F.cos((F.dayofyear(ts) - 15) * F.lit(2 * math.pi) / 365) * -22
    diurnal = F.sin((F.hour(ts) - 6) * F.lit(2 * math.pi) / 24) * 6
    value = F.lit(55.0) + season + diurnal
    return value if decimals is None else half_even(value, decimals)


def above(value: Column, limit: float) -> Column:
    """max(0, value - limit), null for null (``greatest`` alone would give 0)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value - limit))


def below(value: Column, limit: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.lit(limit) - value))


def degree_columns(temp: Column) -> dict[str, Column]:
    return {
        "temp_sq": temp * temp,
        "temp_cooling": above(temp, 65.0),
        "temp_heating": below(temp, 45.0),
    }


def hvac_load(temp: Column) -> Column:
    """Cooling demand above 65 F and heating demand below 45 F, in GW."""
    return above(temp, 65.0) * 0.18 + below(temp, 45.0) * 0.12

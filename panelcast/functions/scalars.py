"""Small scalar expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0  # metres, sphere of the planar projection


def round_even(c, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(c, digits)


def label_if(cond: Column, yes, no) -> Column:
    return F.when(cond, F.lit(yes)).otherwise(F.lit(no))


def in_millions(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c) / F.lit(1e6)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * F.lit(EARTH_RADIUS)


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(3.141592653589793 / 4) + F.radians(lat) / 2)) * F.lit(EARTH_RADIUS)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def linear_grid(start: float, stop: float, step: float) -> list[float]:
    """Arithmetic grid including ``stop`` when it is hit."""
    n = int(round((stop - start) / step))
    return [start + i * step for i in range(n + 1)]


def power_grid(exponents: Sequence[float], base: float = 10.0) -> list[float]:
    return [base**e for e in exponents]


def power_grid_col(lo: int, hi: int, scale: Column) -> Column:
    """``scale * 10^e`` for e = lo..hi as an array column."""
    return F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda e: scale * F.pow(F.lit(10.0), e.cast("double")))

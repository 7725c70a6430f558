"""Distances and grid cells as column expressions. Degrees in, metres out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius in metres, the road detour factor and speed (m/s) of straight-line estimates.
EARTH_M = 6_371_000
DETOUR = 1.3
SPEED_MPS = 13.9


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null where a coordinate is null."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h))) * (2 * EARTH_M)  # least() would skip a null


def planar2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared planar distance in degrees, longitudes scaled at the first point: an order, not a length."""
    x = (lon2 - lon1) * F.greatest(F.cos(F.radians(lat1)), F.lit(1e-6))
    return x * x + (lat2 - lat1) * (lat2 - lat1)


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane scaled at the mean latitude."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * EARTH_M


def road_metres(straight: Column) -> Column:
    return F.round(straight * DETOUR).cast("bigint")


def road_seconds(straight: Column) -> Column:
    return F.round(straight * DETOUR / SPEED_MPS).cast("bigint")


def cell(value: Column, size: float) -> Column:
    """The grid row or column of a coordinate."""
    return F.floor(value / size).cast("bigint")


def quantised(value: Column) -> Column:
    """Coordinates in millionths of a degree."""
    return F.round(value * 1e6).cast("bigint")


def haversine_py(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    h = math.sin(a) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(b) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def grade_factor(rise: Column, run: Column) -> Column:
    """Travel-time factor of a slope: dearer uphill, a little cheaper downhill, 1 where the rise is unknown."""
    g = F.greatest(F.least(rise / run, F.lit(0.30)), F.lit(-0.30))
    return F.when(rise.isNull() | run.isNull() | (run <= 0), 1.0).when(g > 0, 1 + 8 * g).otherwise(F.greatest(1 + 2 * g, F.lit(0.75)))


def decayed(factor: Column, age_ms: Column, half_life_ms: float = 600_000) -> Column:
    """A delay factor's decay towards 1."""
    return 1 + (factor - 1) * F.pow(F.lit(0.5), F.greatest(age_ms, F.lit(0)) / half_life_ms)

"""Capacity vectors, skills and time windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The end of time.
FOREVER = 2**63 // 4


def _both(a: Column, b: Column, f) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.zip_with(a, b, lambda x, y: f(F.coalesce(x, zero), F.coalesce(y, zero)))


def add(a: Column, b: Column) -> Column:
    """Sum of vectors, the shorter padded by zeros."""
    return _both(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x - y)


def fits(load: Column, capacity: Column) -> Column:
    """Whether every dimension of load is within capacity."""
    return F.forall(_both(capacity, load, lambda c, x: c - x), lambda x: x >= 0)


def non_negative(a: Column) -> Column:
    return F.forall(a, lambda x: x >= 0)


def has_skills(required: Column, own: Column) -> Column:
    return F.size(F.array_except(required, own)) == 0


def allows(vehicles: Column, vehicle: Column) -> Column:
    """A null list allows any vehicle."""
    return vehicles.isNull() | F.array_contains(vehicles, vehicle)


def open_window(windows: Column, arrival: Column) -> Column:
    """The first window that has not closed at arrival; without windows, one that never closes; null if all have."""
    always = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(FOREVER).cast("bigint").alias("end"))
    return F.when(F.size(windows) == 0, always).otherwise(F.try_element_at(F.filter(windows, lambda w: w["end"] >= arrival), F.lit(1)))


def latest_end(windows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(windows, lambda w: w["end"])), F.lit(FOREVER).cast("bigint"))


def backhaul(pickup: Column, delivery: Column) -> Column:
    return (F.size(pickup) > 0) & (F.size(delivery) == 0)


def unserved_cost(prize: Column, disjunction: Column) -> Column:
    return F.coalesce(prize, F.lit(1e9)) + F.coalesce(disjunction, F.lit(0.0))


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1)))


def triangle_index(n: Column, i: Column, j: Column) -> Column:
    """The place of (i, j), i <= j, in a row-major upper triangle with its diagonal."""
    return (i * n - F.floor(i * (i - 1) / 2) + (j - i)).cast("bigint")

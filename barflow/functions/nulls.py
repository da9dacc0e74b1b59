"""Arithmetic and comparisons with the missing-value rules of the library.

NULL is the only missing value.  Division by zero gives NULL, a comparison with
NULL makes a flag 0, and clipping keeps NULL (``greatest``/``least`` alone would
skip it).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def change(now: Column, before: Column) -> Column:
    """Fractional change ``now / before - 1``."""
    return F.try_divide(now, before) - 1.0


def is_true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    return is_true(cond).cast("int")


def vote(cond: Column) -> Column:
    """+1 when the condition holds, -1 otherwise (also when it is unknown)."""
    return F.when(is_true(cond), 1.0).otherwise(-1.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    """NULL for NaN and the infinities (NaN sorts above infinity in Spark)."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def sign_of(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x < 0, -1.0).when(x == 0, 0.0)


def bands(x: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """First label whose lower bound (inclusive) is reached, highest first."""
    out = F
    for bound, label in steps:
        out = out.when(x >= bound, label)
    return out.otherwise(otherwise)

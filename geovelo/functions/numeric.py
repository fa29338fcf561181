"""Small column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def rint(x: Column, digits: int = 0) -> Column:
    """Rounded half to even on the binary value, as numpy rounds: rint(x * 10^d) / 10^d."""
    return F.rint(x * float(10**digits)) / float(10**digits)


def finite(x: Column) -> Column:
    """NaN and infinite values as null, so that nothing downstream has to tell them apart."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def strict_sum(x: Column) -> Column:
    """Sum that is null if any value is null, where Spark's sum would leave nulls out."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def strict_least(*xs: Column) -> Column:
    """least that is null if any argument is."""
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in xs]), F.least(*xs))


def strict_greatest(*xs: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in xs]), F.greatest(*xs))


def clamp(x: Column, low: float, high: float) -> Column:
    return strict_greatest(F.lit(float(low)), strict_least(F.lit(float(high)), x))


def require(ok: Column, value: Column, message: str) -> Column:
    """value, or an error where ok is false. The column must be used, or column pruning drops the check with it."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def significant(x: Column, digits: int = 4, unit: float = 1.0) -> Column:
    """x / unit rounded to that many significant digits, for display; 0 and null stay."""
    y = x / unit
    power = F.pow(F.lit(10.0), F.ceil(F.log10(F.abs(y))) - digits)
    return F.when(y == 0, 0.0).otherwise(F.floor(y / power + 0.5) * power)

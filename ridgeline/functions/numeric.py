"""Column expressions with IEEE rather than ANSI semantics, and rounding that hashes alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def ieee_div(n: Column, d: Column) -> Column:
    """n / d where 0/0 is NaN and x/0 is infinite, instead of an error; null stays null."""
    at_zero = F.when(n > 0, F.lit(_INF)).when(n < 0, F.lit(-_INF)).when(n.isNotNull(), F.lit(float("nan")))
    return F.when(d == 0, F.when(F.isnan(n), n).otherwise(at_zero)).otherwise(n / F.when(d != 0, d))


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < _INF), c)


def not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def r6(c: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)

"""Exact rounding of ratios of integers, so that results do not depend on summation order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """numerator/denominator rounded half up to ``digits``, computed in integers."""
    scale = 10 ** digits
    twice = 2 * denominator
    rounded = (2 * numerator * scale + denominator - F.pmod(2 * numerator * scale + denominator, twice)) / twice
    return F.when(denominator != 0, F.round(rounded, 0) / scale)


def sql_ratio(numerator: str, denominator: str, digits: int) -> str:
    """The same in SQL text."""
    s = 10 ** digits
    return f"case when {denominator} <> 0 then ((2 * ({numerator}) * {s} + ({denominator})) // (2 * ({denominator}))) / {s}e0 end"

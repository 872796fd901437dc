"""Numeric functions: base-10 logarithm by its short name, safe division, sign as an integer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log(value: Column) -> Column:
    """Base 10."""
    return F.log10(value)


def sign(value: Column) -> Column:
    return F.signum(value).cast("int")


def safe_divide(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def single_row_zero(statistic: Column, count: Column) -> Column:
    """A sample statistic that is 0, not null, over one row."""
    return F.when(count == 1, F.lit(0.0)).otherwise(statistic)

"""Windows with explicit frames, so that ties and defaults mean the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def over_rows(keys: list, order: list, before: int | None = None, after: int | None = 0):
    """Rows from ``before`` the current one (null: the first) to ``after`` it (null: the last)."""
    start = Window.unboundedPreceding if before is None else -before
    end = Window.unboundedFollowing if after is None else after
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(start, end)


def whole_partition(keys: list, order: list):
    return over_rows(keys, order, None, None)


def first_of(value: Column, keys: list, order: list) -> Column:
    return F.first_value(value).over(whole_partition(keys, order))


def last_of(value: Column, keys: list, order: list) -> Column:
    return F.last_value(value).over(whole_partition(keys, order))


def nth_of(value: Column, n: int, keys: list, order: list) -> Column:
    return F.nth_value(value, n).over(whole_partition(keys, order))


def bucket(n: int, keys: list, order: list) -> Column:
    return F.ntile(n).over(Window.partitionBy(*keys).orderBy(*order))

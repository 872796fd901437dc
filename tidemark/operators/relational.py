"""Relational operators that Spark's SQL has no syntax for, composed from those it has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def distinct_on(frame: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that should be total.

    An aggregation by key with map-side combining: only one row a key and task is shuffled, where a window would deal and
    sort every row of a hot key in one task.  ``order`` must be sortable columns; use negative values to descend.
    """
    rest = F.struct(*[F.col(c) for c in frame.columns])
    first = frame.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("row_"))
    return first.select("row_.*")


def top_per_group(frame: DataFrame, keys: list[str], count: int, *order: Column) -> DataFrame:
    """The first ``count`` rows of each key; Spark limits each task's share before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("rank_", rank).where(F.col("rank_") <= count).drop("rank_")


def any_of(frame: DataFrame, column: Column, comparison: str, values: DataFrame) -> DataFrame:
    """Rows where ``column op ANY (values)``; ``values`` has one column.  One aggregate decides for orderings."""
    name = values.columns[0]
    if comparison == "=":
        return frame.join(values.select(F.col(name).alias("value_")).distinct(), column == F.col("value_"), "left_semi")
    least, most = values.agg(F.min(name)).scalar(), values.agg(F.max(name)).scalar()
    tests = {"<": column < most, "<=": column <= most, ">": column > least, ">=": column >= least, "!=": (column != least) | (column != most)}
    return frame.where(tests[comparison])


def all_of(frame: DataFrame, column: Column, comparison: str, values: DataFrame) -> DataFrame:
    """Rows where ``column op ALL (values)``: true for no values at all, never true against a null."""
    name = values.columns[0]
    agg = lambda f: values.agg(f).scalar()
    count, nulls = agg(F.count("*")), agg(F.count_if(F.col(name).isNull()))
    least, most = agg(F.min(name)), agg(F.max(name))
    tests = {"<": column < least, "<=": column <= least, ">": column > most, ">=": column >= most, "=": (column == least) & (column == most)}
    if comparison == "!=":
        unmatched = frame.join(values.select(F.col(name).alias("value_")).distinct(), column == F.col("value_"), "left_anti")
        return unmatched.where((count == 0) | ((nulls == 0) & column.isNotNull()))
    return frame.where((count == 0) | ((nulls == 0) & tests[comparison]))


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 100) -> DataFrame:
    """Rows reachable from a seed: each round applies ``step`` to the newest rows and keeps what is new.

    Unlike a recursive query, repeats are dropped, so cycles end.  Each round is written to the shared folder, which cuts
    the lineage; the newest rows alone are joined.  What was found lies in one table and at most ``parts`` rounds beside it, so
    plans stay small; the test of what is new reads a round's candidates and what was found, dealt by row.
    """
    scratch, parts = Scratch(seed.sparkSession, "fixpoint"), 8
    new = scratch.save(seed.distinct(), "round0")
    found = new
    for turn in range(1, most + 1):
        keys = new.columns
        new = scratch.save(step(new).select(*keys).subtract(found), f"round{turn}")
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        if turn % parts == 0:
            found = scratch.save(found, f"found{turn}")
            for old in range(max(0, turn - parts), turn):
                scratch.drop(f"round{old}")
            scratch.drop(f"found{turn - parts}")
    raise RuntimeError(f"no fixpoint after {most} rounds")


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """A join whose hot keys of the large side are spread over ``salts`` partitions; the small side is repeated for each.

    For joins that adaptive execution cannot split (outer sides, or a later operator that needs the dealing).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the repeated side must not be preserved")
    spread = large.withColumn("salt_", F.pmod(F.xxhash64(*[F.col(c) for c in large.columns]), F.lit(salts)))
    repeated = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return spread.join(repeated, [*keys, "salt_"], how).drop("salt_")


def null_safe_condition(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> Column:
    """An equality in which null equals null."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out

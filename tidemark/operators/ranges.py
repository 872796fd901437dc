"""Joins by range: points in intervals, and the last row as of a time.

Both are equi-joins or windows over dealt keys, so neither makes a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, at: Column, start: Column, end: Column, width: float) -> DataFrame:
    """Rows of both sides with ``start <= at < end``.

    The line is cut into buckets of ``width``; an interval goes to each bucket that it touches, a point to its own, and the join is on
    the bucket, which adaptive execution can split.  Choose a width near the usual length of an interval.
    """
    bucket = lambda c: F.floor(c / width)
    left = points.withColumns({"at_": at, "bucket_": bucket(at)})
    right = intervals.withColumns({"start_": start, "end_": end}).where("start_ < end_")
    right = right.withColumn("bucket_", F.explode(F.sequence(bucket(F.col("start_")), bucket(F.col("end_")))))
    return left.join(right, "bucket_").where("start_ <= at_ AND at_ < end_").drop("bucket_", "at_", "start_", "end_")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], order: list[str]) -> DataFrame:
    """Each row of the left side with ``columns`` of the right side's last row of its key at or before its time (null: none).

    One exchange and one sort: the sides are put one below the other and a window carries the right side's last row forward.
    ``order`` are columns of the right side that decide among rows of one time (the largest wins).
    """
    clash = {*columns, *order} & {*left.columns}
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    found = F.struct(F.lit(True).alias("is_"), *columns)
    row = F.struct(*left.columns)
    ours = left.select(*keys, F.col(left_time).alias("time_"), F.lit(1).alias("side_"), row.alias("left_"))
    theirs = right.select(*keys, F.col(right_time).alias("time_"), F.lit(0).alias("side_"), found.alias("right_"), F.struct(*order).alias("order_"))
    both = ours.unionByName(theirs, allowMissingColumns=True).where(F.col("time_").isNotNull() | (F.col("side_") == 1))
    window = Window.partitionBy(*keys).orderBy("time_", "side_", "order_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("last_", F.last("right_", ignorenulls=True).over(window)).where("side_ = 1")
    known = F.col("time_").isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    return carried.select("left_.*", *[F.when(known, F.col(f"last_.{c}")).alias(c) for c in columns])

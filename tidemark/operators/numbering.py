"""Global row numbers without gathering a table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def row_numbers(frame: DataFrame, order: str, name: str = "number") -> DataFrame:
    """1, 2, ... in the order of a column: rows are dealt by range, numbered in their range and shifted by the ranges before.

    The ranges are written to the shared folder first, so that the counts and the numbers see the same ones.  Only one count a
    range is gathered.
    """
    dealt = frame.repartitionByRange(order).withColumn("range_", F.spark_partition_id())
    dealt = Scratch(frame.sparkSession, "numbers").save(dealt, "ranges")
    local = F.row_number().over(Window.partitionBy("range_").orderBy(order)).cast("long")
    held = dealt.withColumn("local_", local)
    counts = held.groupBy("range_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("range_", before.alias("start_"))
    return held.join(starts, "range_").withColumn(name, F.col("local_") + F.col("start_")).drop("range_", "local_", "start_")

"""Range and hash partitions: routing, pruned reads and the layout on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def range_route(value: Column, bounds: list[tuple[str, object]]) -> Column:
    """Name of the first partition whose bound exceeds the value; a bound of None takes the rest."""
    out = None
    for name, bound in bounds:
        test = F.lit(True) if bound is None else value < F.lit(bound)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def hash_route(value: Column, count: int) -> Column:
    """Number of the partition of a key."""
    return F.pmod(F.hash(value), F.lit(count))


def range_parts(bounds: list[tuple[str, object]], least: object = None, most: object = None) -> list[str]:
    """Names of the partitions that can hold values from ``least`` to ``most`` (None: no limit)."""
    names, below = [], None
    for name, bound in bounds:
        if (most is None or below is None or below <= most) and (least is None or bound is None or least < bound):
            names.append(name)
        below = bound
        if bound is None:
            break
    return names


def write_routed(frame: DataFrame, path: str, route: Column) -> None:
    """One folder a partition of a route (see :func:`range_route` and :func:`hash_route`)."""
    write_partitioned(frame.withColumn("part", route), path, "part")


def read_routed(spark: SparkSession, path: str, parts: Column | list) -> DataFrame:
    """The rows of some partitions only; no file of another is listed for the scan.  ``parts``: a list or an expression without columns."""
    wanted = F.col("part").isin(parts) if isinstance(parts, list) else F.col("part") == parts
    return spark.read.parquet(path).where(wanted).drop("part")


def write_partitioned(frame: DataFrame, path: str, column: str) -> None:
    """One folder a value, which a filter on the column prunes.

    The rows are rebalanced by the column: small values share a task, and adaptive execution splits a value that is too large for one.
    """
    frame.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)


def write_bucketed(frame: DataFrame, table: str, columns: list[str], count: int) -> None:
    """A table whose equal keys lie together, so that joins and aggregations by them need no shuffle."""
    frame.write.mode("overwrite").bucketBy(count, *columns).sortBy(*columns).saveAsTable(table)

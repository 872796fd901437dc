"""Constraints as queries that return what violates them, and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_violations(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a check is false; unknown passes."""
    return table.where(~F.coalesce(condition, F.lit(True)))


def not_null_violations(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def unique_violations(table: DataFrame, columns: list[str]) -> DataFrame:
    """Keys without a null that occur more than once, and how often."""
    counted = table.where(~reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])).groupBy(*columns).agg(F.count("*").alias("n"))
    return counted.where("n > 1")


def foreign_key_violations(table: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not null and has no parent."""
    known = parent.select(F.col(key).alias("key_"))
    return table.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("key_"), "left_anti")


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, foreign: str, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables after deleting parents and the children that refer to them."""
    from .changes import delete, holds

    dead = parents.where(holds(gone)).select(F.col(key).alias("key_"))
    return delete(parents, gone), children.join(dead, F.col(foreign) == F.col("key_"), "left_anti")


def profile(table: DataFrame) -> DataFrame:
    """Rows, nulls, distinct values, least and greatest of each column, in one pass over the table."""
    measures = []
    for c in table.columns:
        parts = {"n_rows": F.count("*"), "n_null": F.count_if(F.col(c).isNull()), "n_distinct": F.count_distinct(F.col(c)), "least": F.min(c).cast("string"), "greatest": F.max(c).cast("string")}
        measures.append(F.struct(F.lit(c).alias("column_name"), *[v.alias(k) for k, v in parts.items()]).alias(f"c_{c}"))
    return table.agg(*measures).select(F.explode(F.array(*[F.col(f"`c_{c}`") for c in table.columns])).alias("m")).select("m.*")


def common_values(table: DataFrame, column: str, count: int = 10) -> DataFrame:
    """The most common values and their counts; ties by value."""
    return table.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(count)


def histogram(table: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Rows in each of some equally wide ranges from the least to the greatest value."""
    ends = table.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    at = F.least(F.floor((F.col(column).cast("double") - lo) / (hi - lo) * buckets), F.lit(buckets - 1)).cast("long")
    return table.where(F.col(column).isNotNull()).select(at.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))

"""Version logs: every row with the transaction that made it and the one that ended it (0: none yet)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CREATED, DELETED = "created_tx", "deleted_tx"


def start(table: DataFrame, tx: int) -> DataFrame:
    return table.withColumns({CREATED: F.lit(tx).cast("long"), DELETED: F.lit(0).cast("long")})


def visible(log: DataFrame, tx: Column | int) -> Column:
    tx = F.lit(tx) if isinstance(tx, int) else tx
    return (log[CREATED] <= tx) & ((log[DELETED] == 0) | (log[DELETED] > tx))


def as_of(log: DataFrame, tx: Column | int) -> DataFrame:
    """The table at a version."""
    return log.where(visible(log, tx)).drop(CREATED, DELETED)


def current(log: DataFrame) -> DataFrame:
    return log.where(log[DELETED] == 0).drop(CREATED, DELETED)


def as_of_time(log: DataFrame, commits: DataFrame, moment: Column) -> DataFrame:
    """The table at a time: the version of the last commit (tx, at) not after it."""
    tx = commits.where(F.col("at") <= moment).agg(F.coalesce(F.max("tx"), F.lit(-1))).scalar()
    return as_of(log, tx)


def commit(log: DataFrame, tx: int, removed: Column | None = None, added: DataFrame | None = None) -> DataFrame:
    """End the live rows that meet a condition and add new ones."""
    if removed is not None:
        gone = (F.col(DELETED) == 0) & F.coalesce(removed, F.lit(False))
        log = log.withColumn(DELETED, F.when(gone, F.lit(tx)).otherwise(F.col(DELETED)).cast("long"))
    return log if added is None else log.unionByName(start(added, tx))


def history(log: DataFrame) -> DataFrame:
    """All versions, the end of live ones spelt CURRENT."""
    ended = F.when(F.col(DELETED) == 0, "CURRENT").otherwise(F.col(DELETED).cast("string"))
    return log.withColumn(DELETED, ended).withColumn(CREATED, F.col(CREATED).cast("string"))


def vacuum(log: DataFrame) -> DataFrame:
    """Without versions that have ended."""
    return log.where(F.col(DELETED) == 0)


def changes(log: DataFrame, after: int, upto: int) -> DataFrame:
    """INSERT and DELETE events of the transactions in (after, upto]: the log decoded as a change feed."""
    rows = [c for c in log.columns if c not in (CREATED, DELETED)]
    event = lambda kind, at: log.where((F.col(at) > after) & (F.col(at) <= upto)).select(F.col(at).alias("tx"), F.lit(kind).alias("kind"), *rows)
    return event("INSERT", CREATED).unionByName(event("DELETE", DELETED))

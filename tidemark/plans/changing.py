"""Data changes, versions, security and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Mask
from ..operators import changes, constraints, partitions, versions
from .core import query


def _orders(db):
    return db.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT o_orderkey + 1000000, 'N', NULL FROM orders WHERE o_orderkey % 100 = 0")
def insert_select(db):
    new = _orders(db).where("o_orderkey % 100 = 0").select((F.col("o_orderkey") + 1000000).alias("o_orderkey"))
    return changes.insert(_orders(db), new, {"o_orderstatus": F.lit("N")})


_NUMBERED = "SELECT o_orderkey AS old, row_number() OVER (ORDER BY o_orderkey) + (SELECT max(o_orderkey) FROM orders) AS o_orderkey FROM orders WHERE o_orderstatus = 'F'"


@query(_NUMBERED, name="insert_auto_increment_whole")
@query(_NUMBERED)
def insert_auto_increment(db):
    """All orders of one status, inserted again under the next numbers."""
    rows = _orders(db).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("old"))
    return changes.numbered(_orders(db), rows, "o_orderkey", "old").select("old", "o_orderkey")


_INCOMING = "SELECT o_orderkey * 3 AS o_orderkey, 'X' AS o_orderstatus, 1.5 * o_orderkey AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0"


def _incoming(db):
    return _orders(db).where("o_orderkey % 7 = 0").select((F.col("o_orderkey") * 3).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), (F.col("o_orderkey") * 1.5).cast("double").alias("o_totalprice"))


@query(f"WITH i AS ({_INCOMING}) SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) FROM i WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def upsert_nothing(db):
    return changes.upsert_nothing(_orders(db), _incoming(db), ["o_orderkey"], F.col("o_totalprice"))


@query(f"WITH i AS ({_INCOMING}) SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM i) UNION ALL SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) FROM i")
def upsert_update(db):
    return changes.upsert_update(_orders(db), _incoming(db), ["o_orderkey"], F.col("o_totalprice"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'B' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 250000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_where(db):
    return changes.update(_orders(db), F.col("o_totalprice") > 250000, o_orderstatus=F.lit("B"), o_totalprice=F.col("o_totalprice") * 2)


@query("SELECT o_orderkey, o_totalprice AS before, o_totalprice + 1 AS after FROM orders WHERE o_orderstatus = 'P'")
def update_returning(db):
    rows = changes.update_returning(_orders(db), F.col("o_orderstatus") == "P", o_totalprice=F.col("o_totalprice") + 1)
    return rows.select(F.col("old.o_orderkey").alias("o_orderkey"), F.col("old.o_totalprice").alias("before"), F.col("new.o_totalprice").alias("after"))


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS c_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def update_from(db):
    source = db.table("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return changes.update_from(db.table("customer").select("c_custkey", "c_name"), source, ["c_custkey"], ["c_name"])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'F') = 'O', FALSE)")
def delete_where(db):
    return changes.delete(_orders(db), F.nullif("o_orderstatus", F.lit("F")) == "O")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 5000")
def delete_returning(db):
    return changes.delete_returning(_orders(db), F.col("o_totalprice") < 5000).select("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE FALSE")
def truncate_table(db):
    return changes.truncate(_orders(db)).agg(F.count("*").alias("n"))


@query(
    f"""WITH i AS ({_INCOMING}) SELECT coalesce(t.o_orderkey, i.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'NEW' WHEN i.o_orderkey IS NULL THEN t.o_orderstatus ELSE i.o_orderstatus END AS o_orderstatus,
    CAST(CASE WHEN t.o_orderkey IS NULL THEN i.o_totalprice WHEN i.o_orderkey IS NULL THEN t.o_totalprice ELSE t.o_totalprice + i.o_totalprice END AS DOUBLE) AS o_totalprice
    FROM orders t FULL JOIN i ON t.o_orderkey = i.o_orderkey"""
)
def merge_table(db):
    return changes.merge(
        _orders(db), _incoming(db), ["o_orderkey"],
        update={"o_orderstatus": F.col("s.o_orderstatus"), "o_totalprice": F.col("t.o_totalprice") + F.col("s.o_totalprice")},
        insert={"o_orderkey": F.col("s.o_orderkey"), "o_orderstatus": F.lit("NEW"), "o_totalprice": F.col("s.o_totalprice")},
    )


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'valid'")
def insert_validated(db):
    """Insert only rows that meet the checks, are new and have their parent; the others are what violates them."""
    table = db.table("nation").select("n_nationkey", "n_name")
    rows = db.spark.createDataFrame([(100, "valid"), (3, "taken"), (101, None), (-1, "negative")], "n_nationkey int, n_name string")
    bad = constraints.check_violations(rows, F.col("n_nationkey") >= 0).unionByName(constraints.not_null_violations(rows, ["n_name"]))
    good = rows.join(bad, "n_nationkey", "left_anti").join(table, "n_nationkey", "left_anti")
    return changes.insert(table, good)


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '2' ELSE 'CURRENT' END AS deleted_tx FROM customer WHERE c_custkey = 7")
def history_of_key(db):
    return versions.history(_log(db)).where("c_custkey = 7").select("c_custkey", "deleted_tx")


@query("SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'three' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 99, 'new'")
def merge_values(db):
    values = db.spark.createDataFrame([(3, "three"), (99, "new")], "n_nationkey int, n_name string")
    return changes.merge(db.table("nation").select("n_nationkey", "n_name"), values, ["n_nationkey"], update={"n_name": F.col("s.n_name")}, insert={})


@query(f"WITH i AS ({_INCOMING}) SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM i)")
def merge_delete(db):
    gone = changes.merge(_orders(db), _incoming(db), ["o_orderkey"], insert=None, delete_when=F.lit(True))
    return gone.select("o_orderkey")


def _log(db):
    """Customers at version 1; version 2 drops debts; version 3 adds copies of rich ones."""
    rows = db.table("customer").select("c_custkey", "c_acctbal")
    log = versions.commit(versions.start(rows, 1), 2, removed=F.col("c_acctbal") < 0)
    return versions.commit(log, 3, added=rows.where("c_acctbal > 9000").withColumn("c_custkey", F.col("c_custkey") + 1000000))


def _commits(db):
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"), (3, "2024-01-03 00:00:00")]
    return db.spark.createDataFrame(rows, "tx long, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT c_custkey, c_acctbal FROM customer")
def asof_version_1(db):
    return versions.as_of(_log(db), 1)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def asof_timestamp(db):
    return versions.as_of_time(_log(db), _commits(db), F.lit("2024-01-02 09:00:00").cast("timestamp_ntz"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_acctbal > 9000")
def version_current(db):
    return versions.current(_log(db))


_HISTORY = "SELECT '1' AS created_tx, CASE WHEN c_acctbal < 0 THEN '2' ELSE 'CURRENT' END AS deleted_tx, c_custkey, c_acctbal FROM customer UNION ALL SELECT '3', 'CURRENT', c_custkey + 1000000, c_acctbal FROM customer WHERE c_acctbal > 9000"


@query(_HISTORY)
def history_scan(db):
    return versions.history(_log(db))


@query(f"SELECT created_tx, c_custkey FROM ({_HISTORY}) WHERE deleted_tx = 'CURRENT'")
def version_vacuum(db):
    return versions.vacuum(_log(db)).select(F.col("created_tx").cast("string").alias("created_tx"), "c_custkey")


@query("SELECT CAST(2 AS BIGINT) AS tx, 'DELETE' AS kind, c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 3, 'INSERT', c_custkey + 1000000 FROM customer WHERE c_acctbal > 9000")
def change_feed(db):
    return versions.changes(_log(db), 1, 3).select("tx", "kind", "c_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 17 OR o_totalprice < 20000")
def rls_filter(db):
    db.enable_policies("orders", "o_custkey = 17", "o_totalprice < 20000")
    return db.table("orders").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, c_name FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def rls_in_joins(db):
    db.enable_policies("orders", "o_orderstatus = 'F'")
    db.enable_policies("customer", "c_acctbal > 0")
    return db.sql("SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey")


@query(
    """SELECT c_custkey, CASE WHEN length(c_name) > 5 THEN left(c_name, 3) || repeat('*', length(c_name) - 5) || right(c_name, 2) ELSE c_name END AS c_name,
       CASE WHEN length(c_mktsegment) > 0 THEN repeat('#', length(c_mktsegment)) ELSE c_mktsegment END AS c_mktsegment FROM customer"""
)
def mask_columns(db):
    db.mask("customer", Mask("c_name", 3, 2), Mask("c_mktsegment", 0, 0, "#"))
    return db.table("customer").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 50 AND l_discount <= 0.09)")
def check_violations(db):
    return constraints.check_violations(db.table("lineitem"), (F.col("l_quantity") < 50) & (F.col("l_discount") <= 0.09)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL")
def not_null_violations(db):
    rows = _orders(db).withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return constraints.not_null_violations(rows, ["o_orderkey", "o_orderstatus"]).select("o_orderkey")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(db):
    return constraints.unique_violations(db.table("lineitem"), ["l_orderkey", "l_suppkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def fk_violations(db):
    return constraints.foreign_key_violations(db.table("orders"), "o_custkey", db.table("customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def fk_cascade(db):
    _, children = constraints.cascade_delete(db.table("customer"), db.table("orders"), "c_custkey", "o_custkey", F.col("c_acctbal") < 0)
    return children.select("o_orderkey")


def _profile_sql(table: str, columns: list[str]) -> str:
    one = "SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM {t}"
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


@query(_profile_sql("(SELECT nullif(o_orderstatus, 'P') AS o_orderstatus, o_orderkey, o_orderpriority FROM orders)", ["o_orderkey", "o_orderstatus", "o_orderpriority"]))
def column_profile(db):
    rows = db.table("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_orderpriority")
    return constraints.profile(rows)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def column_common_values(db):
    return constraints.common_values(db.table("part"), "p_brand")


@query("SELECT CAST(least(floor((p_size - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bucket, count(*) AS n FROM part, (SELECT CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part) GROUP BY 1")
def column_histogram(db):
    return constraints.histogram(db.table("part"), "p_size")


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'p95' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'p97' ELSE 'rest' END AS part FROM orders")
def partition_range_route(db):
    import datetime

    bounds = [("p95", datetime.date(1996, 1, 1)), ("p97", datetime.date(1998, 1, 1)), ("rest", None)]
    return db.table("orders").select("o_orderkey", partitions.range_route(F.col("o_orderdate"), bounds).alias("part"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def partition_prune_range(db):
    from ..scratch import Scratch

    path = Scratch(db.spark, "partitioned").path("orders")
    partitions.write_partitioned(_orders(db), path, "o_orderstatus")
    return db.spark.read.parquet(path).where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n, 8 AS parts FROM orders")
def partition_hash_route(db):
    routed = db.table("orders").select(partitions.hash_route(F.col("o_custkey"), 8).alias("p"))
    return routed.agg(F.count("*").alias("n"), F.count_distinct("p").cast("int").alias("parts"))

"""Statements of several parts: expression upserts, changes inside queries, checked inserts, routed tables, range joins."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.json import object_agg
from ..operators import changes, partitions, ranges, relational
from ..scratch import Scratch
from .core import both, query

both("join_theta_left", "SELECT n.n_nationkey, s.s_suppkey FROM {nation} n LEFT JOIN {supplier} s ON n.n_nationkey > s.s_suppkey + 10 AND n.n_regionkey <> s.s_nationkey")
both("join_theta_right", "SELECT n.n_nationkey, r.r_regionkey FROM {nation} n RIGHT JOIN {region} r ON n.n_nationkey < r.r_regionkey - 1")
both("param_limit", "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT :count OFFSET :skip", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10", count=25, skip=10)
both(
    "win_default_frame",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, count(*) OVER w AS n, last_value(o_orderpriority) OVER w AS last_priority FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
)
both("agg_first_of_group", "SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS status, count(*) AS n FROM {orders} GROUP BY o_custkey")
both("setop_nested", "(SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal < 0) INTERSECT (SELECT c_custkey FROM {customer} UNION SELECT s_suppkey FROM {supplier})")
both("date_current_time", "SELECT count(*) AS n, bool_and(current_time() IS NOT NULL) AS known FROM {region}", "SELECT count(*) AS n, TRUE AS known FROM region")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, rank() OVER (ORDER BY o_orderpriority, CAST(o_orderdate AS DATE)) AS r FROM orders) WHERE r <= 5")
def limit_with_ties(db):
    """FETCH FIRST 5 ROWS WITH TIES: the rows up to the fifth's key, which one bounded sort finds."""
    rows = db.table("orders").withColumn("key", F.struct("o_orderpriority", F.col("o_orderdate").cast("date").alias("day")))
    last = rows.select("key").orderBy("key").limit(5).agg(F.max("key")).scalar()
    return rows.where(F.col("key") <= last).select("o_orderkey", "o_totalprice")


_SUM = """WITH i AS (SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice) AS total, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey),
    t AS (SELECT c_custkey AS k, c_acctbal AS v, 'T' AS s FROM customer WHERE c_acctbal > 0)
    SELECT coalesce(t.k, i.k) AS k, round(coalesce(v, 0) + coalesce(total, 0), 2) AS v, coalesce(status, s) AS s FROM t FULL JOIN i ON t.k = i.k"""


@query(_SUM)
def upsert_expression(db):
    """Balances to which each order of a customer adds, one after the other; a customer without a balance starts with the first."""
    table = db.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit("T").alias("s"))
    rows = db.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"), "o_orderkey")
    after = changes.upsert_set(table, rows, ["k"], "o_orderkey", lambda old, new: {"v": old["v"] + new["v"], "s": new["s"]})
    return after.withColumn("v", F.round("v", 2))


@query("SELECT o_orderpriority, count(*) AS gone, round(sum(o_totalprice), 2) AS total, (SELECT count(*) FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)) AS left_over FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY o_orderpriority")
def cte_delete_returning(db):
    """WITH gone AS (DELETE ... RETURNING *) SELECT ...: the query sees the returned rows and the table as it is afterwards."""
    orders, dear = db.table("orders"), F.expr("o_orderstatus = 'F' AND o_totalprice > 100000")
    db.change("orders", changes.delete(orders, dear), changes.delete_returning(orders, dear), "gone")
    return db.sql("SELECT o_orderpriority, count(*) AS gone, round(sum(o_totalprice), 2) AS total, (SELECT count(*) FROM {orders}) AS left_over FROM {gone} GROUP BY o_orderpriority")


@query("SELECT o_orderkey, o_totalprice * 2 AS price, 'new' AS state FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, o_totalprice, 'old' FROM orders WHERE o_orderstatus = 'P'")
def cte_update_returning(db):
    """WITH changed AS (UPDATE ... RETURNING old, new) SELECT ... UNION ALL SELECT ...: both images of each row."""
    orders, open_ = db.table("orders"), F.col("o_orderstatus") == "P"
    price = {"o_totalprice": F.col("o_totalprice") * 2}
    db.change("orders", changes.update(orders, open_, **price), changes.update_returning(orders, open_, **price), "changed")
    return db.sql("SELECT new.o_orderkey, o.o_totalprice AS price, 'new' AS state FROM {changed} JOIN {orders} o ON o.o_orderkey = new.o_orderkey UNION ALL SELECT old.o_orderkey, old.o_totalprice, 'old' FROM {changed}")


@query(
    """WITH r AS (SELECT s_suppkey + 20 AS k, s_nationkey AS nation, nullif(s_acctbal, s_acctbal) AS v FROM supplier UNION ALL SELECT c_custkey, c_nationkey + 5, c_acctbal FROM customer),
    f AS (SELECT k, nation, coalesce(v, 0.0) AS v, round(coalesce(v, 0.0) * 2, 2) AS double_v FROM r)
    SELECT k, nation, v, double_v FROM f WHERE v >= 0 AND nation IN (SELECT n_nationkey FROM nation) AND k NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) AND k IN (SELECT k FROM f GROUP BY k HAVING count(*) = 1)
    UNION ALL SELECT p_partkey, 0, p_retailprice, NULL FROM part WHERE p_size < 10"""
)
def insert_constrained(db):
    """An insert with a default, a computed column, a check, a unique key and a parent; what breaks one stays out."""
    table = db.table("part").where("p_size < 10").select(F.col("p_partkey").alias("k"), F.lit(0).alias("nation"), F.col("p_retailprice").alias("v"), F.lit(None).cast("double").alias("double_v"))
    suppliers = db.table("supplier").select((F.col("s_suppkey") + 20).alias("k"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("double").alias("v"))
    rows = suppliers.unionByName(db.table("customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") + 5).alias("nation"), F.col("c_acctbal").alias("v")))
    good, _ = changes.insert_checked(
        table, rows, computed={"double_v": F.round(F.col("v") * 2, 2)}, defaults={"v": F.lit(0.0)}, checks={"v": F.col("v") >= 0}, unique=["k"], parents={"nation": (db.table("nation"), "n_nationkey")}
    )
    return good


@query("SELECT o_orderstatus, '{' || string_agg('\"' || o_orderpriority || '\":' || o_orderkey, ',' ORDER BY o_orderpriority) || '}' AS object FROM (SELECT o_orderstatus, o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) GROUP BY o_orderstatus UNION ALL SELECT 'none', '{}'")
def agg_json_object_last(db):
    """Of a repeated key the last value stays; no rows make an empty object."""
    orders = db.table("orders")
    none = object_agg(orders.where("o_orderkey < 0"), [], "o_orderpriority", "o_orderkey", "o_orderkey").select(F.lit("none").alias("o_orderstatus"), "object")
    return object_agg(orders, ["o_orderstatus"], "o_orderpriority", "o_orderkey", "o_orderkey").unionByName(none)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 17")
def partition_hash_prune(db):
    """A table routed by hash, of which one customer's query reads one part."""
    path = Scratch(db.spark, "routed").path("orders")
    partitions.write_routed(db.table("orders"), path, partitions.hash_route(F.col("o_custkey"), 8))
    part = partitions.hash_route(F.lit(17).cast("long"), 8)
    return partitions.read_routed(db.spark, path, part).where("o_custkey = 17").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate <= TIMESTAMP '1997-03-01'")
def partition_range_prune(db):
    """A table routed by bounds, of which a range reads the parts that can hold it."""
    bounds = [("p95", datetime.datetime(1996, 1, 1)), ("p96", datetime.datetime(1997, 1, 1)), ("p97", datetime.datetime(1998, 1, 1)), ("rest", None)]
    least, most = datetime.datetime(1996, 6, 1), datetime.datetime(1997, 3, 1)
    path = Scratch(db.spark, "routed").path("orders")
    partitions.write_routed(db.table("orders"), path, partitions.range_route(F.col("o_orderdate"), bounds))
    rows = partitions.read_routed(db.spark, path, partitions.range_parts(bounds, least, most))
    return rows.where((F.col("o_orderdate") >= F.lit(least)) & (F.col("o_orderdate") <= F.lit(most))).select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def bucketed_aggregate(db):
    """A table whose customers lie together in buckets: the aggregate by customer has no exchange."""
    name = f"orders_by_customer_{Scratch(db.spark, 'buckets').root[-12:]}"
    partitions.write_bucketed(db.table("orders"), name, ["o_custkey"], 8)
    counted = db.spark.table(name).groupBy("o_custkey").agg(F.count("*").alias("n"))
    kept = Scratch(db.spark, "buckets").save(counted, "counted")
    db.spark.sql(f"DROP TABLE {name}")
    return kept


_ERRORS = "(SELECT event_id AS error_id, ts AS start, ts + INTERVAL 10 MINUTE AS stop FROM events WHERE event_type = 'error')"


@query(f"SELECT e.event_id, x.error_id FROM events e JOIN {_ERRORS} x ON e.ts >= x.start AND e.ts < x.stop WHERE e.event_type = 'purchase'")
def join_interval(db):
    """Purchases within ten minutes of an error, whoever's: points in intervals."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    events = db.table("events")
    points = events.where("event_type = 'purchase'").select("event_id", "ts")
    intervals = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    return ranges.interval_join(points, intervals, seconds("ts"), seconds("error_ts"), seconds("error_ts") + 600, 600).select("event_id", "error_id")


@query(
    """WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT p.event_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def join_asof(db):
    """Each purchase with the user's last view at or before it."""
    events = db.table("events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("event_id").alias("view_order"))
    return ranges.asof_join(events.where("event_type = 'purchase'"), views, ["user_id"], "ts", "ts", ["view_id"], ["view_order"]).select("event_id", "view_id")


@query("SELECT 'orders' AS table_name, 'check' AS kind, 'o_totalprice > 0' AS definition, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS refused UNION ALL SELECT 'orders', 'unique', 'o_orderkey', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def alter_add_constraints(db):
    """ADD CHECK and ADD UNIQUE hold; a foreign key that rows break is refused, and its violations are counted."""
    db.add_constraint("orders", "check", "o_totalprice > 0")
    db.add_constraint("orders", "unique", "o_orderkey")
    db.create("rich", db.table("customer").where("c_acctbal > 0"))
    refused = db.violations("orders", "parent", "o_custkey -> rich.c_custkey").agg(F.count("*").alias("refused"))
    return db.show_constraints().withColumn("refused", refused.scalar())


@query("SELECT 'orders_by_customer' AS name, 'orders' AS table_name, 'o_custkey, o_orderkey' AS columns, (SELECT count(*) FROM orders WHERE o_custkey = 5) AS found")
def index_create_show(db):
    """CREATE INDEX lays the table out by its columns; SHOW INDEXES lists it; the lookup reads what statistics leave."""
    db.create_index("orders_by_customer", "orders", "o_custkey", "o_orderkey")
    db.create_index("gone", "orders", "o_custkey", "o_orderkey")
    db.drop_index("gone")
    return db.show_indexes().withColumn("found", db.table("orders").where("o_custkey = 5").agg(F.count("*")).scalar())


@query("SELECT DISTINCT o_custkey AS node, c_nationkey AS root FROM orders JOIN customer ON c_custkey = o_custkey")
def fixpoint_of_keys(db):
    """A fixpoint over a table of many rows: nations reach their customers, customers who ordered stay."""
    customers = db.table("customer").join(db.table("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("root"))
    seed = db.table("nation").select((-1 - F.col("n_nationkey")).cast("long").alias("node"), F.col("n_nationkey").alias("root"))
    step = lambda new: new.where("node < 0").select("root").join(customers, "root").select("node", "root")
    return relational.fixpoint(seed, step).where("node >= 0")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS number FROM orders")
def numbered_rows(db):
    """Numbers over a whole table without gathering it in one task."""
    from ..operators.numbering import row_numbers

    return row_numbers(db.table("orders").select("o_orderkey"), "o_orderkey")


@query("SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS type, CAST(row_number() OVER () - 1 AS INTEGER) AS position FROM (DESCRIBE orders)")
def describe_columns(db):
    """Names, types and places."""
    return db.describe("orders").select("name", "type", "position")


@query("SELECT o_orderkey, hash_part FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS hash_part FROM orders)")
def partition_hash_together(db):
    """Routing by hash keeps a customer's rows together: counted within the parts, each customer is whole."""
    routed = db.table("orders").withColumn("part", partitions.hash_route(F.col("o_custkey"), 8))
    return routed.select("o_orderkey", F.count("*").over(Window.partitionBy("part", "o_custkey")).alias("hash_part"))


@query("SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.vec_id % 50 = 0")
def vector_similarity(db):
    """Similarities of the query vectors with all later ones of their label."""
    from ..functions.arrays import cosine

    rows = db.table("embeddings")
    one = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("x"), "label", F.col("embedding").cast("array<double>").alias("e"))
    two = rows.select(F.col("vec_id").alias("y"), "label", F.col("embedding").cast("array<double>").alias("f"))
    return one.join(two, "label").where("x < y").select("x", "y", F.round(cosine(F.col("e"), F.col("f")), 6).alias("similarity"))

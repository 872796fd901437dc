"""Scans, projections, filters, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .core import both, query

both(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n
       FROM {lineitem} WHERE l_shipdate <= DATE '2001-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
both("scan_project", "SELECT o_orderkey, o_custkey, o_totalprice * 2 AS doubled FROM {orders}")
both("scan_star", "SELECT * FROM {nation}")
both("select_without_from", "SELECT 1 + 1 AS two, 'x' AS letter, CAST(NULL AS BIGINT) AS nothing")
both("values_source", "SELECT id, name FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(id, name)")
both("row_count", "SELECT count(*) AS n FROM {lineitem}")
both("filter_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate >= DATE '1998-01-01'")
both("filter_not_between", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity NOT BETWEEN 3 AND 48")
both("filter_in_list", "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (1, 2, 3)")
both("filter_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%in%' AND p_type NOT LIKE '_M%'")
both("filter_ilike", "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_mktsegment ILIKE '%BUILD%' OR c_mktsegment ILIKE 'auto%'")
both("filter_is_null", "SELECT o_orderkey FROM {orders} WHERE nullif(o_orderstatus, 'F') IS NULL")
both("filter_is_not_null", "SELECT o_orderkey FROM {orders} WHERE nullif(o_orderstatus, 'F') IS NOT NULL AND NOT (o_totalprice < 1000)")
both("filter_boolean_logic", "SELECT event_id FROM {events} WHERE (event_type = 'click' AND value > 50) OR NOT (event_type <> 'error' OR user_id % 2 = 0)")
both("point_lookup", "SELECT * FROM {orders} WHERE o_orderkey = 77")
both("range_lookup", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey >= 100 AND o_orderkey < 200")
both("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM {orders}")
both("case_searched", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'small' END AS class FROM {customer}")
both(
    "cast_matrix",
    """SELECT o_orderkey, CAST(o_orderkey AS STRING) AS key_text, CAST(CAST(o_orderkey AS STRING) AS BIGINT) AS key_back, CAST(o_orderkey % 2 AS BOOLEAN) AS odd,
       CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS DOUBLE) AS key_real, CAST(o_orderdate AS DATE) AS day FROM {orders}""",
)
both("arith_exprs", "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - l_tax AS s, round(l_extendedprice * l_discount, 4) AS m, l_linenumber / 2 AS d, -l_linenumber AS neg, l_orderkey % 7 AS r FROM {lineitem}")
both("null_logic", "SELECT o_orderkey, nullif(o_orderstatus, 'F') = 'O' AS eq, nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O' AS differs, coalesce(nullif(o_orderstatus, 'F') = 'O', FALSE) AS known FROM {orders}")
both("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
both("order_nulls_first", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM {orders} ORDER BY s ASC NULLS FIRST, o_orderkey LIMIT 50")
both("order_by_expression", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
both("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}")
both("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
both("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 0")
both("except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 5000")
both("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}")
both("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}")
both("setop_precedence", "SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 5 UNION SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier} WHERE s_nationkey > 20")
both("setop_ordered", "(SELECT n_nationkey AS k FROM {nation} UNION SELECT o_custkey AS k FROM {orders}) ORDER BY k DESC LIMIT 12")
both("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 5")
def topk_per_group(db):
    from ..operators.relational import top_per_group

    rows = db.table("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_per_group(rows, ["l_returnflag"], 5, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(db):
    from ..operators import relational

    rows = db.table("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.distinct_on(rows, ["o_custkey"], -F.col("o_totalprice"), F.col("o_orderkey"))


@query("SELECT count(*) AS n FROM (SELECT * FROM events LIMIT 10)")
def sample_scan(db):
    from ..sources.files import sample_rows

    return sample_rows(db.table("events"), 10).agg(F.count("*").alias("n"))


@query("SELECT 'nation' AS name, 'table' AS kind UNION ALL SELECT 'open_orders', 'view'")
def show_tables(db):
    db.create_view("open_orders", "SELECT * FROM {orders} WHERE o_orderstatus = 'O'")
    return db.show_tables().where("name IN ('nation', 'open_orders')")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 5 OR (o_orderstatus = 'P' AND o_totalprice > 200000)")
def index_bitmap_or(db):
    """What a bitmap combination of indexes answers: Parquet statistics and pushed filters do it in one scan."""
    return db.table("orders").where((F.col("o_custkey") == 5) | ((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000))).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal - 100 <= 5100 AND c_acctbal + 100 >= 5000")
def index_range_overlap(db):
    """Intervals [balance - 100, balance + 100] that overlap [5000, 5100]."""
    lo, hi = F.col("c_acctbal") - 100, F.col("c_acctbal") + 100
    return db.table("customer").where((lo <= 5100) & (hi >= 5000)).select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (5, 9)")
def index_composite_layout(db):
    """A copy sorted by (customer, key), so that row-group statistics skip what a composite index would."""
    from ..scratch import Scratch

    path = Scratch(db.spark, "layout").path("orders")
    db.table("orders").repartitionByRange("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey").write.mode("overwrite").parquet(path)
    return db.spark.read.parquet(path).where(F.col("o_custkey").isin(5, 9)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5, 9, 13)")
def positional_fetch(db):
    """Rows by a set of keys: a semi-join whose small side Spark broadcasts below its own size threshold."""
    wanted = db.spark.createDataFrame([(k,) for k in (1, 5, 9, 13)], "o_orderkey long")
    return db.table("orders").join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("SELECT TRUE AS has_scan, TRUE AS has_filter")
def explain_plan(db):
    plan = db.sql("EXPLAIN FORMATTED SELECT o_orderkey FROM {orders} WHERE o_totalprice > 1000")
    return plan.select(F.col("plan").contains("Scan parquet").alias("has_scan"), F.col("plan").contains("PushedFilters").alias("has_filter"))


@query("SELECT column_name AS name FROM (DESCRIBE orders)")
def describe_table(db):
    return db.describe("orders").select("name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def view_expansion(db):
    db.create_view("open_orders", "SELECT * FROM {orders} WHERE o_orderstatus = 'O'")
    return db.sql("SELECT o_orderkey, o_totalprice FROM {open_orders} WHERE o_totalprice > 100000")


@query("SELECT o_orderkey AS id, o_totalprice * 0.5 AS half FROM orders", name="alter_table_whole")
@query("SELECT o_orderkey AS id, o_totalprice * 0.5 AS half FROM orders")
def alter_table(db):
    changed = db.table("orders").withColumn("half", F.col("o_totalprice") * 0.5).withColumnRenamed("o_orderkey", "id").drop("o_orderstatus")
    db.create("orders_2", changed)
    db.rename("orders_2", "orders_3")
    return db.table("orders_3").select("id", "half")

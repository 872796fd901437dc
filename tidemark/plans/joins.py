"""Joins of every type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational
from .core import both, query

both("join_inner", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000")
both("join_left", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000")
both("join_right", "SELECT o.o_orderkey, c.c_custkey, c.c_name FROM {orders} o RIGHT JOIN {customer} c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
both("join_full", "SELECT s.s_suppkey, c.c_custkey FROM {supplier} s FULL JOIN {customer} c ON s.s_suppkey = c.c_custkey")
both("join_full_whole", "SELECT s.s_suppkey, c.c_custkey FROM {supplier} s FULL JOIN {customer} c ON s.s_suppkey = c.c_custkey")
both("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
both("join_theta", "SELECT a.s_suppkey AS low, b.n_nationkey AS high FROM {supplier} a JOIN {nation} b ON a.s_suppkey < b.n_nationkey AND a.s_nationkey <> b.n_nationkey")
both("join_self", "SELECT a.n_name AS one, b.n_name AS other FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both(
    "join_multiway",
    """SELECT r.r_name, n.n_name, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
       FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
       JOIN {nation} n ON c.c_nationkey = n.n_nationkey AND s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name""",
)
both("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_tax > 0.05")
both("join_using", "SELECT n_regionkey, count(*) AS n FROM {nation} JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM {region}) r USING (n_regionkey) GROUP BY n_regionkey")
both("semi_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)")
both("semi_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
both("anti_not_in", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)")
both("anti_not_in_null", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM {orders})")
both("anti_not_exists", "SELECT s_suppkey FROM {supplier} s WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49.5 AND l.l_tax > 0.07)")


@query("SELECT a.o_orderkey, b.n_nationkey FROM (SELECT o_orderkey, nullif(o_custkey % 25, 3) AS k FROM orders) a JOIN (SELECT n_nationkey, nullif(n_nationkey, 7) AS j FROM nation) b ON a.k IS NOT DISTINCT FROM b.j")
def join_null_safe(db):
    a = db.table("orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 25, F.lit(3)).alias("k"))
    b = db.table("nation").select("n_nationkey", F.nullif("n_nationkey", F.lit(7)).alias("j"))
    return a.join(b, relational.null_safe_condition(a, b, ("k", "j"))).select("o_orderkey", "n_nationkey")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def join_salted(db):
    lines = db.table("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity")
    orders = db.table("orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    joined = relational.salted_join(lines, orders, ["k"], 4)
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))

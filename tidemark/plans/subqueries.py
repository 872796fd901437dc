"""Subqueries, common table expressions, recursion and parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational
from .core import both, query

both("scalar_subquery", "SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM {customer}), 4) AS above FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer})")
both("correlated_subquery", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
both("scalar_in_select", "SELECT c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n FROM {customer} c")
both("derived_table", "SELECT s.k, s.n FROM (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) s WHERE s.n >= 10")
both("cte_cascade", "WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
both("cte_recursive", "WITH RECURSIVE t(n, a, b) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM t WHERE n < 60) SELECT n, a AS fibonacci FROM t")
both(
    "lateral_topn",
    "SELECT n.n_name, t.s_suppkey, t.s_acctbal FROM {nation} n, LATERAL (SELECT s_suppkey, s_acctbal FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) t",
    "SELECT n_name, s_suppkey, s_acctbal FROM (SELECT n_name, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM nation JOIN supplier ON s_nationkey = n_nationkey) WHERE r <= 2",
)
both(
    "param_query",
    "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000.0",
    status="F",
    least=200000.0,
)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > ANY (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P')")
def quantified_any(db):
    orders = db.table("orders")
    return relational.any_of(orders, F.col("o_totalprice"), ">", orders.where("o_orderstatus = 'P'").select("o_totalprice")).select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def quantified_any_equal(db):
    nations = db.table("nation").where("n_regionkey = 1").select("n_nationkey")
    return relational.any_of(db.table("supplier"), F.col("s_nationkey"), "=", nations).select("s_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders)", name="quantified_all_whole")
@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders)")
def quantified_all(db):
    orders = db.table("orders")
    return relational.all_of(orders, F.col("o_totalprice"), ">=", orders.select("o_totalprice")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey <> ALL (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def quantified_all_unequal(db):
    nations = db.table("supplier").where("s_acctbal > 9000").select("s_nationkey")
    return relational.all_of(db.table("customer"), F.col("c_nationkey"), "!=", nations).select("c_custkey")


@query(
    """WITH RECURSIVE r(origin, node) AS (SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey < 5
       UNION SELECT origin, (node * 2 + 1) % 25 FROM r) SELECT origin, node FROM r"""
)
def recursive_fixpoint(db):
    """Nodes reachable in a graph with cycles."""
    seed = db.table("nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("origin"), F.col("n_nationkey").alias("node"))
    return relational.fixpoint(seed, lambda new: new.select("origin", ((F.col("node") * 2 + 1) % 25).alias("node")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey = 8")
def prepared_statement(db):
    from ..operators.procedures import Prepared

    statement = Prepared(db.sql, "SELECT o_orderkey FROM {orders} WHERE o_custkey = :customer")
    return statement.execute(customer=7).unionAll(statement.execute(customer=8))


both("cte_body_changed", "WITH gone AS (SELECT * FROM {orders} WHERE o_orderstatus = 'F') SELECT count(*) AS n, min(o_orderkey) AS first_key FROM gone")

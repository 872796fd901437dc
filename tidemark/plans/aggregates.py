"""Grouping and aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.maths import single_row_zero
from .core import both, query

both("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM {orders}")
both("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS top FROM {orders} WHERE o_orderkey < 0")
both("agg_group_multi", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderstatus, o_orderpriority")
both("agg_group_expr", "SELECT o_orderkey % 10 AS digit, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM {orders} GROUP BY o_orderkey % 10")
both("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 1000000")
both("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(l_partkey) AS n FROM {lineitem} GROUP BY l_returnflag")
both("agg_count_nulls", "SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS known, count(DISTINCT nullif(o_orderstatus, 'F')) AS kinds FROM {orders}")
both("agg_sum_distinct", "SELECT CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, CAST(sum(l_linenumber) AS BIGINT) AS a FROM {lineitem}")
both("agg_minmax", "SELECT p_brand, min(p_retailprice) AS least, max(p_retailprice) AS most, min(p_name) AS first_name, max(p_size) AS size FROM {part} GROUP BY p_brand")
both("agg_arithmetic", "SELECT l_returnflag, round(sum(l_extendedprice) / count(*), 4) AS mean, round(max(l_quantity) - min(l_quantity), 2) AS spread FROM {lineitem} GROUP BY l_returnflag")
both("agg_bool", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS some FROM {orders} GROUP BY o_orderpriority")
both("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
both("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
both("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
both("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) AS n FROM {orders} GROUP BY o_orderpriority")
both("agg_null_group", "SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS n FROM {orders} GROUP BY nullif(o_orderstatus, 'F')")
both(
    "agg_string_agg",
    "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
both(
    "agg_string_agg_distinct",
    "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|') WITHIN GROUP (ORDER BY o_orderpriority) AS priorities FROM {orders} GROUP BY o_orderstatus",
    "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus",
)


@query(
    """SELECT c_nationkey, round(stddev_samp(c_acctbal), 4) AS sd, round(var_samp(c_acctbal), 2) AS var, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(c_acctbal) END, 4) AS sd_zero
       FROM customer GROUP BY c_nationkey"""
)
def agg_stddev_var(db):
    sd = F.stddev_samp("c_acctbal")
    return db.table("customer").groupBy("c_nationkey").agg(
        F.round(sd, 4).alias("sd"), F.round(F.var_samp("c_acctbal"), 2).alias("var"), F.round(single_row_zero(sd, F.count("*")), 4).alias("sd_zero")
    )


@query("SELECT r_name, n_name, key FROM (SELECT r_name, n_name, n_nationkey AS key FROM nation JOIN region ON n_regionkey = r_regionkey)")
def agg_json_object(db):
    """An object a region, from name to key, taken apart again so that the order of keys does not matter."""
    rows = db.table("nation").join(db.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("k"), F.col("n_nationkey").alias("v"))))
    objects = rows.groupBy("r_name").agg(F.to_json(F.map_from_entries(entries)).alias("object"))
    return objects.select("r_name", F.explode(F.from_json("object", "map<string,int>")).alias("n_name", "key"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) > 0 AS some FROM lineitem GROUP BY l_returnflag")
def agg_approx_distinct(db):
    """A sketch of distinct counts within 5 % of the exact one."""
    exact, sketch = F.count_distinct("l_orderkey"), F.approx_count_distinct("l_orderkey", 0.01)
    return db.table("lineitem").groupBy("l_returnflag").agg((F.abs(sketch - exact) <= 0.05 * exact).alias("some"))


@query(
    """SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_orderstatus"""
)
def agg_pandas(db):
    """A user-defined aggregate over Arrow batches."""
    @F.pandas_udf("double")
    def total(values: pd.Series) -> float:
        return float(values.sum())

    @F.pandas_udf("long")
    def rows(values: pd.Series) -> int:
        return len(values)

    # the aggregate gathers a group in one task: pre-sum by a salt, so that no group is whole anywhere
    salted = db.table("orders").groupBy("o_orderstatus", F.pmod("o_orderkey", F.lit(16)).alias("salt")).agg(total("o_totalprice").alias("part"), rows("o_totalprice").alias("n"))
    return salted.groupBy("o_orderstatus").agg(F.round(F.sum("part"), 2).alias("total"), F.sum("n").alias("n"))

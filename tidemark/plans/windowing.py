"""Window functions, with explicit frames and total orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows
from .core import both, query

both("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM {orders}")
both(
    "win_rank_dense",
    "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS BIGINT) AS d FROM {lineitem}",
)
both("win_percent_rank", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey), 6) AS cd FROM {part}")
both(
    "win_lag_lead",
    """SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after,
       lag(value, 1, -1.0D) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_or FROM {events}""",
    """SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after,
       lag(value, 1, -1.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_or FROM events""",
)
both(
    "win_running_sum",
    "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM {events}",
)
both(
    "win_moving_avg_rows",
    "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS moving, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ahead FROM {events}",
)
both("win_range_frame", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM {lineitem}")
both("win_partition_totals", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share, min(o_totalprice) OVER (PARTITION BY o_custkey) AS least FROM {orders}")
both("win_expr_nested", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) * 10 + 1 AS code, CASE WHEN rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 THEN 'top' ELSE 'rest' END AS place FROM {orders}")
both("win_over_groups", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS of_status FROM {orders} GROUP BY o_orderstatus, o_orderpriority")


@query("SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quarter FROM customer")
def win_ntile(db):
    return db.table("customer").select("c_custkey", windows.bucket(4, ["c_nationkey"], ["c_acctbal", "c_custkey"]).cast("long").alias("quarter"))


@query(
    """SELECT o_orderkey, first_value(o_totalprice) OVER w AS first_price, last_value(o_totalprice) OVER w AS last_price, nth_value(o_totalprice, 2) OVER w AS second_price FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def win_first_last_nth(db):
    keys, order, price = ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_totalprice")
    return db.table("orders").select(
        "o_orderkey", windows.first_of(price, keys, order).alias("first_price"), windows.last_of(price, keys, order).alias("last_price"), windows.nth_of(price, 2, keys, order).alias("second_price")
    )


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS number FROM orders")
def win_global_number(db):
    """A number for each row of a whole table, without gathering it in one task."""
    from ..operators.numbering import row_numbers

    return row_numbers(db.table("orders").select("o_orderkey"), "o_orderkey")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS recent FROM events")
def win_frame_helper(db):
    frame = windows.over_rows(["event_type"], ["ts", "event_id"], 3, 0)
    return db.table("events").select("event_id", F.round(F.sum("value").over(frame), 4).alias("recent"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR")
def win_gaps(db):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = db.table("events").withColumn("before", F.lag("ts").over(order))
    return rows.where("before IS NULL OR ts - before > INTERVAL '6' HOUR").select("user_id", "event_id")

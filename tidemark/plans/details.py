"""Databases, blocks that return queries, live answers with little room, and row-level forms of queries that elsewhere return a test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Databases
from ..functions import dates, json, text
from ..operators import procedures, vectors
from ..streaming import live
from .core import query
from .files_and_streams import _stream


@query(
    """SELECT 'open' AS name, TRUE AS current, count(*) AS n FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT 'shop', FALSE, count(*) FROM orders"""
)
def database_use(db):
    """Two databases over one folder, of which one has a table of its own; a third is dropped."""
    databases = Databases(db.spark)
    for name in ("shop", "open", "gone"):
        databases.create(name, db.folder)
    databases.drop("gone")
    own = databases.use("open")
    own.create("orders", db.table("orders").where("o_orderstatus = 'O'"))
    sizes = [databases.catalogs[n].table("orders").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("shop", "open")]
    return databases.show().join(sizes[0].union(sizes[1]), "name").select("name", "current", "n")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000.0 AND o_orderstatus = 'O'")
def block_return_query(db):
    """A block that returns a query, called in FROM; a name within quotes is not a variable."""
    db.table("orders").createOrReplaceTempView("orders_of_block")
    body = procedures.block_query("DECLARE o DOUBLE; BEGIN o := least * 2; RETURN QUERY SELECT o_orderkey, o_totalprice FROM orders_of_block WHERE o_totalprice > o AND o_orderstatus = 'O'; END")
    procedures.create_table_function(db.spark, "dear_orders", "least DOUBLE", "o_orderkey BIGINT, o_totalprice DOUBLE", body)
    return db.spark.sql("SELECT o_orderkey, o_totalprice FROM dear_orders(100000.0D)")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def live_query_evict(db):
    """A reader with room for one answer finds the newest."""
    stream, scratch = _stream(db, 1)
    reader = live.Subscriber(1, "evict")

    def publish(answer, number):
        answer.write.mode("overwrite").parquet(scratch.path(f"answer{number}"))
        reader.post(number)

    counts = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    live.live_query(stream, counts, publish, scratch.path("progress"))
    return db.spark.read.parquet(scratch.path(f"answer{reader.take()}"))


@query(
    """SELECT o_orderkey, o_orderdate + INTERVAL 45 SECOND AS s, o_orderdate - INTERVAL 90 MINUTE AS mi, o_orderdate + INTERVAL 5 HOUR AS h, o_orderdate + INTERVAL 10 DAY AS d,
       o_orderdate - INTERVAL 14 DAY AS w, o_orderdate + INTERVAL 1 MONTH AS mo, o_orderdate - INTERVAL 2 YEAR AS y FROM orders"""
)
def date_shift_units(db):
    amounts = {"s": "45 seconds", "mi": "-90 minutes", "h": "5 hours", "d": "10 days", "w": "-2 weeks", "mo": "1 month", "y": "-2 years"}
    return db.table("orders").select("o_orderkey", *[dates.shift_text(F.col("o_orderdate"), a).alias(n) for n, a in amounts.items()])


@query("SELECT n_nationkey, TRUE AS is_time FROM nation")
def date_current_time(db):
    """The clock cannot be compared with another engine's: only the form is."""
    return db.table("nation").select("n_nationkey", F.regexp(dates.current_time(), F.lit("^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$")).alias("is_time"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 3 AND 5 AS within, json_extract_string(props, '$.k') = '4' AS inside FROM events")
def json_contained_by_values(db):
    """A value within a list, and a document within a larger one that holds another value for most rows."""
    props = F.col("props")
    among = json.array_contains_all(F.lit("[3, 4, 5]"), F.to_json(F.array(json.get(props, "k").cast("long"))))
    return db.table("events").select("event_id", among.alias("within"), json.contains(F.lit('{"x": 1, "k": 4}'), props).alias("inside"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ') AS name FROM part")
def str_initcap_words(db):
    return db.table("part").select("p_partkey", text.capitalised(F.upper("p_name")).alias("name"))


@query("SELECT 10 AS n, 10 AS ids, 10 AS known FROM range(1)")
def sample_scan_rows(db):
    """Ten different rows, each of which the table holds as it is."""
    from ..sources.files import sample_rows

    events = db.table("events")
    found = sample_rows(events, 10)
    known = found.alias("a").join(events.alias("b"), F.expr("a.event_id = b.event_id AND a.value <=> b.value AND a.ts <=> b.ts"), "left")
    return known.agg(F.count("*").cast("int").alias("n"), F.count_distinct("a.event_id").cast("int").alias("ids"), F.count("b.event_id").cast("int").alias("known"))


@query("SELECT item_id, text FROM benchmark WHERE length(text) % 2 = 0")
def semantic_match_text(db):
    """Text operands: a text matches itself in capitals, and not another one."""
    other = F.when(F.length("text") % 2 == 0, F.upper("text")).otherwise(F.lit("zyx wvu tsr"))
    return vectors.semantic_match(db.table("benchmark").withColumn("other", other), "text", "other").select("item_id", "text")


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, TRUE AS near FROM lineitem GROUP BY l_returnflag")
def agg_approx_near_exact(db):
    """A sketch beside the exact count, within three of its standard errors."""
    exact, sketch = F.count_distinct("l_orderkey"), F.approx_count_distinct("l_orderkey", 0.01)
    return db.table("lineitem").groupBy("l_returnflag").agg(exact.alias("exact"), (F.abs(sketch - exact) <= 0.03 * exact).alias("near"))

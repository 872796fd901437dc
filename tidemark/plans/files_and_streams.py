"""File round trips, user-defined functions and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import procedures
from ..scratch import Scratch
from ..sources import files
from ..streaming import live
from .core import query


@query("SELECT n_nationkey, n_name, nullif(n_regionkey, 2) AS n_regionkey, n_nationkey % 2 = 0 AS even, 'a \"b\", c' AS odd_text FROM nation")
def copy_csv_roundtrip(db):
    rows = db.table("nation").select("n_nationkey", "n_name", F.nullif("n_regionkey", F.lit(2)).alias("n_regionkey"), (F.col("n_nationkey") % 2 == 0).alias("even"), F.lit('a "b", c').alias("odd_text"))
    path = Scratch(db.spark, "copy").path("nation.csv")
    files.copy_to_csv(rows, path)
    return files.copy_from_csv(db.spark, path, rows.schema)


@query("SELECT n_nationkey, n_name FROM nation")
def copy_csv_tab(db):
    rows = db.table("nation").select("n_nationkey", "n_name")
    path = Scratch(db.spark, "copy").path("nation.tsv")
    files.copy_to_csv(rows, path, header=False, delimiter="TAB")
    return files.copy_from_csv(db.spark, path, rows.schema, header=False, delimiter="TAB")


@query("SELECT event_id, nullif(event_type, 'click') AS event_type, value FROM events", name="copy_jsonl_roundtrip_whole")
@query("SELECT event_id, nullif(event_type, 'click') AS event_type, value FROM events")
def copy_jsonl_roundtrip(db):
    rows = db.table("events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"), "value")
    path = Scratch(db.spark, "copy").path("events.jsonl")
    files.copy_to_jsonl(rows, path)
    return files.copy_from_jsonl(db.spark, path, rows.schema)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def udf_sql(db):
    procedures.create_sql_function(db.spark, "net_price", "price DOUBLE, discount DOUBLE", "DOUBLE", "round(price * (1 - discount), 4)")
    return db.sql("SELECT l_orderkey, l_linenumber, net_price(l_extendedprice, l_discount) AS net FROM {lineitem}")


@query("SELECT o_orderkey, o_custkey * 2 + 10 AS code FROM orders")
def udf_block(db):
    body = procedures.block_expression("DECLARE base BIGINT := 5; twice BIGINT; BEGIN twice := customer * 2; base := base + 5; RETURN twice + base; END")
    procedures.create_sql_function(db.spark, "order_code", "customer BIGINT", "BIGINT", body)
    return db.sql("SELECT o_orderkey, order_code(o_custkey) AS code FROM {orders}")


@query("SELECT c_custkey, c_custkey % 97 + length(c_name) AS h FROM customer")
def udf_pandas(db):
    @F.pandas_udf("long")
    def mix(key: pd.Series, name: pd.Series) -> pd.Series:
        return key % 97 + name.str.len()

    return db.table("customer").select("c_custkey", mix("c_custkey", "c_name").alias("h"))


@query("SELECT c_custkey, part FROM (SELECT c_custkey, unnest(string_split(c_name, '#')) AS part FROM customer)")
def udtf_split(db):
    """A Python table function; each row of the table is one call."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="part: string")
    class Split:
        def eval(self, text: str, mark: str):
            for part in text.split(mark):
                yield (part,)

    db.spark.udtf.register("split_text", Split)
    return db.sql("SELECT c_custkey, part FROM {customer}, LATERAL split_text(c_name, '#')")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 11")
def udtf_sql(db):
    db.table("orders").createOrReplaceTempView("orders_of_view")
    procedures.create_table_function(db.spark, "orders_of", "customer BIGINT", "o_orderkey BIGINT", "SELECT o_orderkey FROM orders_of_view WHERE o_custkey = customer")
    return db.spark.sql("SELECT o_orderkey FROM orders_of(11)")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 300000.0")
def procedure_call(db):
    db.table("orders").createOrReplaceTempView("orders_called")
    return procedures.call(db.spark, "CREATE OR REPLACE TEMPORARY VIEW dear AS SELECT * FROM orders_called WHERE o_totalprice > 300000.0; SELECT count(*) AS n FROM dear")


def _stream(db, files_a_batch: int = 2, parts: int = 4):
    """The events as a stream of files, with the folders for its output and its progress."""
    scratch = Scratch(db.spark, "stream")
    events = db.table("events")
    events.repartitionByRange(parts, "ts").write.parquet(scratch.path("events"))
    return live.file_stream(db.spark, scratch.path("events"), events.schema, files_a_batch), scratch


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def window_tumbling(db):
    return live.tumbling(live.event_time(db.table("events")), "6 hours", "event_type", n=F.count("*"), total=F.round(F.sum("value"), 4))


@query(
    """SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, count(*) AS n FROM
       (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 12 HOUR AS w FROM events, (VALUES (0), (1)) AS v(i)) GROUP BY w"""
)
def window_sliding(db):
    return live.sliding(live.event_time(db.table("events")), "1 day", "12 hours", n=F.count("*"))


_SESSIONS = """SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, user_id, count(*) AS n FROM
       (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
       (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""


@query(_SESSIONS)
def window_session(db):
    return live.sessions(live.event_time(db.table("events")), "2 hours", "user_id", n=F.count("*"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def live_query_complete(db):
    stream, scratch = _stream(db)

    def publish(answer, number):
        answer.write.mode("overwrite").parquet(scratch.path(f"answer{number % 2}"))
        answer.sparkSession.createDataFrame([(number,)], "n long").write.mode("overwrite").parquet(scratch.path("last"))

    query = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    live.live_query(stream, query, publish, scratch.path("progress"))
    number = db.spark.read.parquet(scratch.path("last")).first()["n"]
    return db.spark.read.parquet(scratch.path(f"answer{number % 2}"))


@query("SELECT event_id, user_id, round(value * 2, 4) AS double_value FROM events WHERE event_type = 'purchase'")
def stream_stateless(db):
    stream, scratch = _stream(db)
    rows = stream.where("event_type = 'purchase'").select("event_id", "user_id", F.round(F.col("value") * 2, 4).alias("double_value"))
    live.run_available(rows, scratch.path("sink"), scratch.path("progress"))
    return db.spark.read.parquet(scratch.path("sink"))


@query("SELECT user_id, count(*) AS n FROM events JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey GROUP BY user_id")
def stream_static_join(db):
    stream, scratch = _stream(db)
    rich = db.table("customer").where("c_acctbal > 0").select("c_custkey")
    live.run_available(stream.join(rich, F.col("user_id") == F.col("c_custkey")).select("event_id", "user_id"), scratch.path("sink"), scratch.path("progress"))
    return db.spark.read.parquet(scratch.path("sink")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def stream_after_trigger(db):
    """A function of each batch appends the rows it is interested in."""
    stream, scratch = _stream(db)
    audit = lambda batch, _: batch.where("event_type = 'error'").select("event_id").write.mode("append").parquet(scratch.path("audit"))
    live.after_change(stream, audit, scratch.path("progress"))
    return db.spark.read.parquet(scratch.path("audit"))


@query("SELECT DISTINCT user_id FROM events")
def stream_deduplicate(db):
    stream, scratch = _stream(db)
    live.run_available(live.first_of_each(live.event_time(stream, delay="60 days"), "user_id").select("user_id"), scratch.path("sink"), scratch.path("progress"))
    return db.spark.read.parquet(scratch.path("sink"))


def _closed_windows(db, build):
    """Windows that a stream has closed, in append mode: a last event far ahead lets the watermark pass all others."""
    stream, scratch = _stream(db, 4, 4)  # files that arrive together are one batch, so none is late
    schema = db.table("events").schema
    late = db.table("events").orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + INTERVAL '400' DAY"))
    live.run_available(build(live.event_time(stream)), scratch.path("sink"), scratch.path("progress"))
    late.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode("append").parquet(scratch.path("events"))
    again = live.file_stream(db.spark, scratch.path("events"), schema, 1)
    live.run_available(build(live.event_time(again)), scratch.path("sink"), scratch.path("progress"))
    return db.spark.read.parquet(scratch.path("sink"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(db):
    return _closed_windows(db, lambda events: live.tumbling(events, "1 day", n=F.count("*")))


@query(_SESSIONS)
def stream_session(db):
    return _closed_windows(db, lambda events: live.sessions(events, "2 hours", "user_id", n=F.count("*")))

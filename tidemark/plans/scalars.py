"""Scalar functions: strings, numbers, dates, JSON and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, dates, json, maths, text
from .core import both, query


@query("SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, length(c_name) AS n, trim(concat('  ', c_name, ' ')) AS t, ltrim('  x') AS l, rtrim('x  ') AS r FROM customer")
def str_case_trim(db):
    c = F.col
    return db.table("customer").select(
        "c_custkey", F.upper("c_mktsegment").alias("up"), F.lower("c_name").alias("low"), text.char_count(c("c_name")).cast("long").alias("n"),
        text.trim_space(F.concat(F.lit("  "), c("c_name"), F.lit(" "))).alias("t"), text.ltrim_space(F.lit("  x")).alias("l"), text.rtrim_space(F.lit("x  ")).alias("r"),
    )


@query("SELECT p_partkey, substring(p_name, 1, 3) AS a, substring(p_name, 4) AS b, substring(p_name, 900, 2) AS c, left(p_name, 4) AS l, right(p_name, 3) AS r FROM part")
def str_substring(db):
    name = F.col("p_name")
    return db.table("part").select(
        "p_partkey", text.substr(name, -2, 3).alias("a"), text.substr(name, 4).alias("b"), text.substr(name, 900, 2).alias("c"), F.left(name, F.lit(4)).alias("l"), F.right(name, F.lit(3)).alias("r")
    )


@query("SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS l, rpad(s_name, 5, '*') AS r, replace(s_name, '0', 'o') AS o, repeat('ab', 2) AS rep FROM supplier")
def str_pad_replace(db):
    return db.table("supplier").select(
        "s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("l"), F.rpad("s_name", 5, "*").alias("r"), F.replace(F.col("s_name"), F.lit("0"), F.lit("o")).alias("o"), F.repeat(F.lit("ab"), 2).alias("rep")
    )


@query("SELECT n_nationkey, CAST(strpos(n_name, 'A') AS INTEGER) AS p, reverse(n_name) AS r FROM nation")
def str_position_reverse(db):
    return db.table("nation").select("n_nationkey", text.position(F.lit("A"), F.col("n_name")).alias("p"), F.reverse("n_name").alias("r"))


@query("SELECT o_orderkey, concat(o_orderstatus, '-', nullif(o_orderpriority, '1-URGENT')) AS joined, o_orderstatus || '/' || o_orderpriority AS piped FROM orders")
def str_concat_nulls(db):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return db.table("orders").select("o_orderkey", text.concat_all(status, F.lit("-"), F.nullif(priority, F.lit("1-URGENT"))).alias("joined"), F.concat(status, F.lit("/"), priority).alias("piped"))


@query("SELECT r_regionkey, 'Two Words éx' AS phrase, upper(left(r_name, 1)) || lower(substring(r_name, 2)) AS name FROM region WHERE r_name NOT LIKE '% %'")
def str_initcap(db):
    return db.table("region").where("r_name NOT LIKE '% %'").select(
        "r_regionkey", text.capitalised(F.lit("  two   WORDS Éx")).alias("phrase"), text.capitalised(F.col("r_name")).alias("name")
    )


both(
    "math_all",
    """SELECT c_custkey, round(abs(c_acctbal), 2) AS a, round(sqrt(abs(c_acctbal)), 6) AS sq, round(power(c_custkey, 0.5), 6) AS po, round(ln(c_custkey + 1), 6) AS l, round(exp(c_custkey % 5), 6) AS e,
       CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, round(c_acctbal, 1) AS ro, c_custkey % 7 AS mo FROM {customer}""",
)


@query("SELECT c_custkey, round(log10(c_custkey + 1), 6) AS l, CAST(sign(c_acctbal) AS INTEGER) AS s, round(c_acctbal / nullif(c_custkey % 3, 0), 4) AS d FROM customer")
def math_compat(db):
    return db.table("customer").select(
        "c_custkey", F.round(maths.log(F.col("c_custkey") + 1), 6).alias("l"), maths.sign(F.col("c_acctbal")).alias("s"), F.round(maths.safe_divide(F.col("c_acctbal"), F.col("c_custkey") % 3), 4).alias("d")
    )


both("math_null_helpers", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, greatest(o_custkey, nullif(o_orderkey % 50, 0)) AS g, least(o_custkey, nullif(o_orderkey % 50, 0)) AS l FROM {orders}")


@query("SELECT 36 AS n, TRUE AS distinct_ids FROM range(1)")
def uuid_text(db):
    ids = db.table("nation").select(F.uuid().alias("u"))
    return ids.agg(F.max(F.length("u")).cast("int").alias("n"), (F.count_distinct("u") == F.count("*")).alias("distinct_ids"))


@query(
    """SELECT event_id, date_trunc('year', ts) AS y, date_trunc('month', ts) AS mo, date_trunc('day', ts) AS d, date_trunc('hour', ts) AS h, date_trunc('minute', ts) AS mi, date_trunc('second', ts) AS s FROM events"""
)
def date_trunc_parts(db):
    names = zip(("y", "mo", "d", "h", "mi", "s"), dates.PARTS)
    return db.table("events").select("event_id", *[dates.trunc(part, F.col("ts")).alias(n) for n, part in names])


@query(
    """SELECT event_id, extract(year FROM ts) AS year, extract(month FROM ts) AS month, extract(day FROM ts) AS day, extract(hour FROM ts) AS hour, extract(minute FROM ts) AS minute,
       CAST(floor(extract(second FROM ts)) AS BIGINT) AS second, extract(dow FROM ts) AS dow, extract(doy FROM ts) AS doy, CAST(floor(extract(epoch FROM ts)) AS BIGINT) AS epoch FROM events"""
)
def date_extract_parts(db):
    return db.table("events").select("event_id", *[dates.extract(f, F.col("ts")).alias(f.lower()) for f in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "DOW", "DOY", "EPOCH")])


@query(
    """SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS d, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 2 YEAR AS y, o_orderdate + INTERVAL 90 MINUTE AS mi, o_orderdate - INTERVAL 3 DAY AS t FROM orders"""
)
def date_add_sub(db):
    day = F.col("o_orderdate")
    return db.table("orders").select(
        "o_orderkey", dates.add(day, 10, "day").alias("d"), dates.add(day, 1, "month").alias("m"), dates.subtract(day, 2, "year").alias("y"), dates.add(day, 90, "minute").alias("mi"), dates.shift_text(day, "-3 days").alias("t")
    )


@query(
    """SELECT o_orderkey, datesub('day', o_orderdate, TIMESTAMP '2000-03-01 12:00:00') AS d, datesub('month', o_orderdate, TIMESTAMP '2000-03-01 12:00:00') AS m,
       datesub('year', o_orderdate, TIMESTAMP '2000-03-01 12:00:00') AS y, datesub('hour', o_orderdate, TIMESTAMP '2000-03-01 12:00:00') AS h FROM orders"""
)
def date_diff_units(db):
    end = F.lit("2000-03-01 12:00:00").cast("timestamp_ntz")
    return db.table("orders").select("o_orderkey", *[dates.diff(unit, F.col("o_orderdate"), end).alias(n) for n, unit in (("d", "day"), ("m", "month"), ("y", "year"), ("h", "hour"))])


@query(
    """SELECT event_id, format('{} days {} hours {} mins {} secs', s // 86400, s // 3600 % 24, s // 60 % 60, s % 60) AS age
       FROM (SELECT event_id, datesub('second', TIMESTAMP '2023-12-01 00:00:00', ts) AS s FROM events)"""
)
def date_age_text(db):
    return db.table("events").select("event_id", dates.age(F.col("ts"), F.lit("2023-12-01 00:00:00").cast("timestamp_ntz")).alias("age"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS text, strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d')::DATE AS day, date_trunc('second', ts) AS back FROM events")
def date_format_parse(db):
    ts = F.col("ts")
    form = "YYYY-MM-DD HH24:MI:SS"
    return db.table("events").select(
        "event_id", dates.to_char(ts, "YYYY/MM/DD HH24:MI:SS").alias("text"), dates.to_date(dates.to_char(ts, "YYYY-MM-DD"), "YYYY-MM-DD").alias("day"), dates.to_timestamp(dates.to_char(ts, form), form).alias("back")
    )


@query("SELECT TRUE AS same_day, TRUE AS ordered FROM range(1)")
def date_now(db):
    return db.spark.range(1).select((F.to_date(F.current_timestamp()) == F.current_date()).alias("same_day"), (F.current_timestamp() <= F.now()).alias("ordered"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_arrow(db):
    return db.table("events").select("event_id", json.get(F.col("props"), "k").cast("long").alias("k"), json.get(F.col("props"), "none").alias("missing"))


@query("SELECT event_id, json_extract_string(props, '$.k') = '7' AS has_seven, json_extract_string(props, '$.k') = '7' AS inside FROM events")
def json_contains(db):
    props, seven = F.col("props"), F.lit('{"k": 7}')
    return db.table("events").select("event_id", json.contains(props, seven).alias("has_seven"), json.contains(F.concat(F.lit('{"x": 1, '), F.substr(props, F.lit(2))), seven).alias("inside"))


@query("SELECT event_id, TRUE AS within, json_extract_string(props, '$.k') IN ('1', '2') AS among FROM events")
def json_contained_by(db):
    """The mirror image: a document within a larger one, and an element within a list."""
    props = F.col("props")
    larger = F.concat(F.lit('{"x": 1, '), F.substr(props, F.lit(2)))
    among = json.array_contains_all(F.lit("[1, 2]"), F.to_json(F.array(json.get(props, "k").cast("long"))))
    return db.table("events").select("event_id", json.contains(larger, props).alias("within"), among.alias("among"))


@query("SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.q') AS has_q FROM events")
def json_has_key(db):
    return db.table("events").select("event_id", json.has_key(F.col("props"), "k").alias("has_k"), json.has_key(F.col("props"), "q").alias("has_q"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, '1' AS one FROM events")
def json_merge(db):
    left = F.concat(F.lit('{"one": 1, "kind": "none", '), F.substr(F.col("props"), F.lit(2)))
    merged = json.merge(left, F.to_json(F.struct(F.col("event_type").alias("kind"))))
    return db.table("events").select("event_id", merged["k"].alias("k"), merged["kind"].alias("kind"), merged["one"].alias("one"))


@query("""SELECT n_nationkey, format('{{"key":{},"name":"{}"}}', n_nationkey, n_name) AS object, format('[{},{}]', n_nationkey, n_regionkey) AS list FROM nation""")
def json_build(db):
    return db.table("nation").select("n_nationkey", json.build_object(name=F.col("n_name"), key=F.col("n_nationkey")).alias("object"), json.build_array(F.col("n_nationkey"), F.col("n_regionkey")).alias("list"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS deep, event_type AS second FROM events")
def json_extract_path(db):
    nested = F.to_json(F.struct(F.array(F.lit("x"), F.col("event_type")).alias("list"), F.from_json("props", "k long").alias("p")))
    return db.table("events").select("event_id", json.extract_path(nested, "p", "k").alias("deep"), json.extract_path(nested, "list", 1).alias("second"))


@query(
    """SELECT * FROM (VALUES ('null', 'null'), ('true', 'boolean'), ('12.5', 'number'), ('-3', 'number'), ('"x"', 'string'), ('[1]', 'array'), ('{"a":1}', 'object'), ('plain', 'string')) AS t(doc, kind)"""
)
def json_typeof(db):
    rows = [(x,) for x in ("null", "true", "12.5", "-3", '"x"', "[1]", '{"a":1}', "plain")]
    return db.spark.createDataFrame(rows, "doc string").select("doc", json.kind_of(F.col("doc")).alias("kind"))


@query("SELECT event_id, user_id AS k FROM events")
def json_set(db):
    return db.table("events").select("event_id", json.set_key(F.col("props"), "k", F.col("user_id"))["k"].cast("long").alias("k"))


@query("SELECT n_nationkey, x AS element FROM nation, (VALUES (0), (1)) AS v(i), LATERAL (SELECT CASE i WHEN 0 THEN n_name ELSE CAST(n_regionkey AS VARCHAR) END AS x) t")
def json_array_explode(db):
    docs = F.to_json(F.array(F.col("n_name"), F.col("n_regionkey").cast("string")))
    return db.table("nation").select("n_nationkey", F.explode(json.elements(docs)).alias("element"))


@query("SELECT n_nationkey, n_name AS first FROM nation")
def json_array_elements_first(db):
    return db.table("nation").select("n_nationkey", json.first_element(F.to_json(F.array("n_name", "n_name"))).alias("first"))


@query("SELECT vec_id, len(embedding) AS n, list_contains([label, 3], 3) AS has3, array_to_string([label, label + 1], '-') AS joined, label + 2 AS last FROM embeddings")
def array_ops(db):
    label = F.col("label")
    return db.table("embeddings").select(
        "vec_id", arrays.length(F.col("embedding")).cast("long").alias("n"), F.array_contains(F.array(label, F.lit(3)), F.lit(3)).alias("has3"),
        F.array_join(F.array(label, label + 1).cast("array<string>"), "-").alias("joined"), F.element_at(F.array_append(F.array(label, label + 1), label + 2), -1).alias("last"),
    )


@query("SELECT vec_id, len(embedding[3:5]) AS n, CAST(embedding[3] AS DOUBLE) AS first, len(embedding[61:]) AS tail FROM embeddings")
def array_slice_zero_based(db):
    cut = arrays.slice_from_zero(F.col("embedding"), 2, 5)
    return db.table("embeddings").select("vec_id", F.size(cut).cast("long").alias("n"), F.get(cut, F.lit(0)).cast("double").alias("first"), F.size(arrays.slice_from_zero(F.col("embedding"), 60)).cast("long").alias("tail"))

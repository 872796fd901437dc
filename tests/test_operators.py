"""Edge semantics on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Mask
from tidemark.functions import arrays, dates, json, text
from tidemark.operators import changes, constraints, numbering, partitions, procedures, relational, search, versions, windows
from tidemark.sources import files


@pytest.fixture
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("v")).first()["v"]


def ints(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_nulls_first_and_grouping(spark):
    users = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Unknown", None)], "id int, name string, age int")
    assert [r["id"] for r in users.orderBy("age").collect()] == [3, 2, 1]
    assert users.where("age > 20").count() == 2 and users.where("age IS NULL").count() == 1
    assert ints(users.groupBy("age").count(), "age", "count") == [(None, 1), (25, 1), (30, 1)]


def test_window_ties_and_edges(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([100, 100, 100, 90, 80, 80], 1)], "id int, val int")
    w = Window.partitionBy().orderBy(F.desc("val"))
    assert [r["r"] for r in rows.select("id", F.rank().over(w).alias("r")).orderBy("id").collect()] == [1, 1, 1, 4, 5, 5]
    run = rows.select("id", F.sum("val").over(windows.over_rows([], ["id"])).alias("s"), F.lag("val", 1).over(Window.orderBy("id")).alias("l")).orderBy("id").collect()
    assert [r["s"] for r in run] == [100, 200, 300, 390, 470, 550] and run[0]["l"] is None
    assert [r["b"] for r in rows.where("id <= 4").select("id", windows.bucket(2, [], ["id"]).alias("b")).orderBy("id").collect()] == [1, 1, 2, 2]


def test_distinct_on_and_numbering(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (2, 1, None), (None, 2, "n"), (None, 1, "m")], "k int, v int, t string")
    assert ints(relational.distinct_on(rows, ["k"], F.col("v")), "k", "v") == [(None, 1), (1, 3), (2, 1)]
    numbered = numbering.row_numbers(spark.range(1000).repartition(7), "id").collect()
    assert all(r["number"] == r["id"] + 1 for r in numbered)


def test_quantified(spark):
    rows = spark.createDataFrame([(1,), (5,), (9,), (None,)], "x int")
    some, none, with_null = (spark.createDataFrame([(v,) for v in vs], "y int") for vs in ([3, 5], [], [3, None]))
    keep = lambda f: [r["x"] for r in f.collect()]
    assert sorted(keep(relational.any_of(rows, F.col("x"), ">", some))) == [5, 9]
    assert keep(relational.any_of(rows, F.col("x"), "=", some)) == [5]
    assert keep(relational.any_of(rows, F.col("x"), "<", none)) == []
    assert keep(relational.all_of(rows, F.col("x"), ">", some)) == [9]
    assert len(keep(relational.all_of(rows, F.col("x"), ">", none))) == 4
    assert keep(relational.all_of(rows, F.col("x"), ">", with_null)) == []
    assert keep(relational.all_of(rows, F.col("x"), "!=", with_null)) == []


def test_fixpoint_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a int, b int")
    seed = spark.createDataFrame([(1,)], "n int")
    step = lambda new: new.join(edges, new["n"] == edges["a"]).select(F.col("b").alias("n"))
    assert ints(relational.fixpoint(seed, step), "n") == [(1,), (2,), (3,), (4,)]


def test_salted_join(spark):
    large = spark.range(100).select(F.lit(1).alias("k"), "id")
    small = spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string")
    assert relational.salted_join(large, small, ["k"], 4).count() == 100
    with pytest.raises(ValueError):
        relational.salted_join(large, small, ["k"], 4, "full")


def test_changes(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, name string, n int")
    updated = changes.update(table, F.col("n") > 0, name=F.lit("z"))
    assert ints(updated, "id", "name") == [(1, "z"), (2, "b")]
    assert ints(changes.delete(table, F.col("n") > 0), "id") == [(2,)]
    merged = changes.merge(table, spark.createDataFrame([(2, "B"), (3, "C")], "id int, name string"), ["id"], update={"name": F.col("s.name")}, insert={})
    assert ints(merged, "id", "name", "n") == [(1, "a", 1), (2, "B", None), (3, "C", None)]
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "id int, name string")
    with pytest.raises(Exception, match="several source rows"):
        changes.merge(table, twice, ["id"], update={"name": F.col("s.name")}).collect()
    assert ints(changes.upsert_update(table.select("id", "name"), twice, ["id"], F.col("name")), "id", "name") == [(1, "y"), (2, "b")]
    assert ints(changes.insert(table, spark.createDataFrame([(7,)], "id int"), {"name": F.lit("d")}), "id", "name", "n")[-1] == (7, "d", None)


def test_versions(spark):
    table = spark.createDataFrame([(1, 10), (2, 20)], "id int, v int")
    log = versions.commit(versions.start(table, 1), 2, removed=F.col("id") == 1, added=spark.createDataFrame([(1, 11)], "id int, v int"))
    assert ints(versions.as_of(log, 1), "id", "v") == [(1, 10), (2, 20)]
    assert ints(versions.as_of(log, 2), "id", "v") == [(1, 11), (2, 20)]
    assert versions.as_of(log, 0).count() == 0
    assert sorted(r["deleted_tx"] for r in versions.history(log).collect()) == ["2", "CURRENT", "CURRENT"]
    assert versions.vacuum(log).count() == 2
    assert ints(versions.changes(log, 1, 2), "tx", "kind", "v") == [(2, "DELETE", 10), (2, "INSERT", 11)]


def test_policies_and_masks(spark):
    db = Catalog(spark, "/nowhere")
    db.create("t", spark.createDataFrame([(1, "ann", "x"), (2, "bob", None)], "id int, owner string, data string"))
    db.enable_policies("t", "owner = 'ann'", "data = 'y'")
    assert [r["id"] for r in db.table("T").collect()] == [1]
    db.enable_policies("t")
    with pytest.raises(PermissionError):
        db.table("t")
    db.create("u", spark.createDataFrame([("abcdef",), ("ab",), ("",), (None,)], "s string"))
    db.mask("u", Mask("s", 1, 2, "#"))
    assert sorted(r["s"] or "" for r in db.table("u").collect()) == ["", "", "a###ef", "ab"]
    db.create_view("v", "SELECT upper(s) AS s FROM {u}")
    assert db.sql("SELECT * FROM {v} WHERE s = :s", s="AB").count() == 1
    with pytest.raises(KeyError):
        db.drop("nothing")


def test_constraints(spark):
    rows = spark.createDataFrame([(1, 5), (1, -1), (None, 3), (None, None)], "k int, n int")
    assert ints(constraints.check_violations(rows, F.col("n") > 0), "n") == [(-1,)]
    assert ints(constraints.unique_violations(rows, ["k"]), "k", "n") == [(1, 2)]
    assert constraints.not_null_violations(rows, ["k", "n"]).count() == 2
    parents = spark.createDataFrame([(5,), (3,)], "id int")
    assert ints(constraints.foreign_key_violations(rows, "n", parents, "id"), "n") == [(-1,)]
    kept, children = constraints.cascade_delete(parents, rows, "id", "n", F.col("id") == 5)
    assert ints(kept, "id") == [(3,)] and children.count() == 3
    profile = {r["column_name"]: r for r in constraints.profile(rows).collect()}
    assert profile["k"]["n_null"] == 2 and profile["k"]["n_distinct"] == 1 and profile["n"]["least"] == "-1"


def test_text_functions(one):
    assert value(one, text.substr(F.lit("hello"), 0, 3)) == "hel" and value(one, text.substr(F.lit("hello"), 9, 3)) == ""
    assert value(one, text.concat_all(F.lit("a"), F.lit(None), F.lit(1))) == "a1"
    assert value(one, text.char_count(F.lit(None).cast("string"))) == 0
    assert value(one, text.trim_space(F.lit("  x y  "))) == "x y"
    assert value(one, text.capitalised(F.lit("  two   WORDS élan "))) == "Two Words élan"
    assert value(one, text.position(F.lit("z"), F.lit("abc"))) == 0


def test_date_functions(one):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    assert value(one, dates.age(stamp("2024-01-03 04:05:06"), stamp("2024-01-01 00:00:00"))) == "2 days 4 hours 5 mins 6 secs"
    assert str(value(one, dates.add(stamp("2024-01-31 00:00:00"), 1, "month"))) == "2024-02-29 00:00:00"
    assert value(one, dates.diff("month", stamp("2024-01-31 00:00:00"), stamp("2024-03-01 00:00:00"))) == 1
    assert value(one, dates.extract("DOW", stamp("2024-01-07 00:00:00"))) == 0
    assert value(one, dates.to_char(stamp("2024-01-07 15:04:05"), "DD.MM.YYYY HH24:MI:SS")) == "07.01.2024 15:04:05"
    assert str(value(one, dates.to_timestamp(F.lit("07/01/24 03:04 PM"), "DD/MM/YY HH12:MI PM"))) == "2024-01-07 15:04:00"
    assert str(value(one, dates.shift_text(stamp("2024-01-01 00:00:00"), "2 weeks"))) == "2024-01-15 00:00:00"


def test_json_functions(one):
    a, b = F.lit('{"a": 1, "b": {"c": [1, 2]}}'), F.lit('{"a": 1}')
    assert value(one, json.contains(a, b)) and not value(one, json.contains(b, a)) and not value(one, json.contains(F.lit("no"), b))
    assert value(one, json.extract_path(a, "b", "c", 1)) == "2" and value(one, json.get(a, "zz")) is None
    assert value(one, json.merge(a, F.lit('{"a": 9}')))["a"] == "9" and value(one, json.set_key(b, "x", F.lit("y"))) == {"a": "1", "x": "y"}
    assert value(one, json.has_key(a, "b")) and not value(one, json.has_key(a, "c"))
    assert value(one, json.array_contains_all(F.lit("[1, 2, 3]"), F.lit("[3, 1]")))


def test_array_functions(one):
    a = F.array(*[F.lit(float(x)) for x in (1, 2, 3)])
    assert value(one, arrays.slice_from_zero(a, 1, 2)) == [2.0] and value(one, arrays.slice_from_zero(a, 1)) == [2.0, 3.0] and value(one, arrays.slice_from_zero(a, 2, 1)) == []
    assert value(one, arrays.cosine(a, a)) == pytest.approx(1.0) and value(one, arrays.cosine(a, F.array(F.lit(1.0)))) == 0.0
    assert value(one, arrays.cosine(a, F.array(*[F.lit(0.0)] * 3))) == 0.0


def test_search(spark, one):
    assert value(one, search.tokens(F.lit("The quick-brown FOX, 42!"))) == ["the", "quick", "brown", "fox", "42"]
    assert value(one, search.tokens(F.lit("The fox is quick"), stop=True)) == ["fox", "quick"]
    assert value(one, search.match(F.lit("anything"), "the is")) is True and value(one, search.match(F.lit(None).cast("string"), "fox")) is False
    docs = spark.createDataFrame([(1, "fox fox dog"), (2, "fox cat bird cow horse"), (3, "dog")], "id int, t string")
    scores = {r["id"]: r["score"] for r in search.bm25(docs, "id", "t", "fox").collect()}
    assert set(scores) == {1, 2} and scores[1] > scores[2]
    assert value(one, search.highlight_all(F.lit("Fox and fox"), ["fox"])) == "<b>Fox</b> and <b>fox</b>"
    assert value(one, search.snippet(F.lit("x" * 50 + "needle" + "y" * 50), ["needle"], 20)) == "..." + "x" * 5 + "needle" + "y" * 9 + "..."


def test_partitions(one):
    route = partitions.range_route(F.lit(15), [("a", 10), ("b", 20), ("c", None)])
    assert value(one, route) == "b" and value(one, partitions.range_route(F.lit(99), [("a", 10)])) is None
    assert 0 <= value(one, partitions.hash_route(F.lit("k"), 4)) < 4


def test_procedures(spark):
    assert procedures.block_expression("BEGIN RETURN 1 + x; END") == "1 + x"
    body = procedures.block_expression("DECLARE a INT := 2; b INT; BEGIN b := a * n; a := a + 1; RETURN a + b; END")
    procedures.create_sql_function(spark, "block_test", "n INT", "INT", body)
    assert spark.sql("SELECT block_test(5) AS v").first()["v"] == 13
    with pytest.raises(ValueError):
        procedures.block_expression("SELECT 1")


def test_copy(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "hi", ok', True, 1.5), (2, None, False, None), (3, "two\nlines", None, 0.0)], "id int, bio string, active boolean, score double")
    files.copy_to_csv(rows, f"file://{tmp_path}/a")
    assert sorted(map(tuple, files.copy_from_csv(spark, f"file://{tmp_path}/a", rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    files.copy_to_jsonl(rows, f"file://{tmp_path}/b")
    assert sorted(map(tuple, files.copy_from_jsonl(spark, f"file://{tmp_path}/b", rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "c.csv").write_text("id,bio,active,score\n1,NULL,yes,2\n2,,t,3\n")
    assert [tuple(r) for r in files.copy_from_csv(spark, f"file://{tmp_path}/c.csv", rows.schema).orderBy("id").collect()] == [(1, None, True, 2.0), (2, None, True, 3.0)]

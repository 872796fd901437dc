"""Edge semantics of upserts with expressions, checked inserts, routed tables and joins by range."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.functions.json import object_agg
from tidemark.operators import changes, partitions, ranges, relational


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_upsert_acts_row_by_row(spark):
    """Expressions see the row as the rows before have left it; a new key's first row is inserted as it is."""
    table = spark.createDataFrame([(1, 10, "a"), (2, 5, "b")], "k int, n int, s string")
    rows = spark.createDataFrame([(1, 3, "x", 1), (1, 4, None, 2), (3, 7, "y", 1), (3, 2, "z", 2), (None, 1, "n", 1)], "k int, n int, s string, seq int")
    after = changes.upsert_set(table, rows, ["k"], "seq", lambda old, new: {"n": old["n"] * 2 + new["n"], "s": F.coalesce(new["s"], old["s"])})
    assert rows_of(after, "k", "n", "s") == sorted([(1, 50, "x"), (2, 5, "b"), (3, 16, "z"), (None, 1, "n")], key=repr)
    assert after.schema.names == table.schema.names
    empty = changes.upsert_set(table, rows.limit(0), ["k"], "seq", lambda old, new: {})
    assert rows_of(empty, "k", "n", "s") == [(1, 10, "a"), (2, 5, "b")]


def test_insert_checked(spark):
    table = spark.createDataFrame([(1, "p", 2)], "id int not null, parent string, twice int")
    parents = spark.createDataFrame([("p",), ("q",)], "name string")
    rows = spark.createDataFrame([(1, "p"), (2, None), (3, "missing"), (4, "q"), (4, "q"), (-5, "q"), (None, "p"), (6, "q")], "id int, parent string")
    options = dict(computed={"twice": F.col("id") * 2}, defaults={"parent": F.lit("p")}, checks={"id is positive": F.col("id") > 0}, unique=["id"], parents={"parent": (parents, "name")})
    after, refused = changes.insert_checked(table, rows, **options)
    assert rows_of(after, "id", "parent", "twice") == [(1, "p", 2), (2, "p", 4), (6, "q", 12)]
    found = {(r["id"], tuple(r["violates"])) for r in refused.collect()}
    assert found == {(1, ("unique",)), (3, ("parent of parent",)), (4, ("unique",)), (-5, ("id is positive",)), (None, ("not null id",))}


def test_all_unequal_has_no_nested_loop(spark):
    rows = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    values = lambda *vs: spark.createDataFrame([(v,) for v in vs], "y int")
    keep = lambda *vs: rows_of(relational.all_of(rows, F.col("x"), "!=", values(*vs)), "x")
    assert keep(5, 7) == [(1,)] and keep(5, None) == [] and keep(7, 7) == [(1,), (5,)]
    assert rows_of(relational.all_of(rows, F.col("x"), "!=", values(1).limit(0)), "x") == [(1,), (5,), (None,)]
    assert "NestedLoop" not in plan_of(relational.all_of(rows, F.col("x"), "!=", values(5)))


def test_fixpoint_of_many_rounds(spark):
    """A chain longer than the rounds that are kept apart."""
    seed = spark.createDataFrame([(0,)], "n int")
    found = relational.fixpoint(seed, lambda new: new.select((F.col("n") + 1).alias("n")).where("n < 21"))
    assert rows_of(found, "n") == sorted([(i,) for i in range(21)], key=repr)
    with pytest.raises(RuntimeError):
        relational.fixpoint(seed, lambda new: new.select((F.col("n") + 1).alias("n")), most=3)


def test_routed_tables(spark, tmp_path):
    bounds = [("a", 10), ("b", 20), ("rest", None)]
    assert partitions.range_parts(bounds) == ["a", "b", "rest"]
    assert partitions.range_parts(bounds, 10, 15) == ["b"] and partitions.range_parts(bounds, 9, 10) == ["a", "b"]
    assert partitions.range_parts(bounds, 25) == ["rest"] and partitions.range_parts(bounds, most=3) == ["a"]
    rows = spark.range(30)
    path = f"file://{tmp_path}/routed"
    partitions.write_routed(rows, path, partitions.range_route(F.col("id"), bounds))
    found = partitions.read_routed(spark, path, ["b"])
    assert rows_of(found, "id") == sorted([(i,) for i in range(10, 20)], key=repr)
    assert "PartitionFilters: [" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert all("part=b" in r["file"] for r in found.select(F.input_file_name().alias("file")).collect())


def test_rebalanced_folders(spark, tmp_path):
    """A value with most of the rows is not bound to one task: the exchange may be split."""
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 5))
    partitions.write_partitioned(rows, f"file://{tmp_path}/t", "k")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 1000
    assert "RebalancePartitions" in plan_of(rows.hint("rebalance", "k"))


def test_interval_join(spark):
    pick = random.Random(1)
    points = [(i, pick.uniform(-50, 50)) for i in range(200)] + [(900, None), (901, 3.0)]
    spans = [(i, a, a + pick.choice([0, 0.5, 7, 60])) for i, a in enumerate(pick.uniform(-60, 60) for _ in range(40))] + [(99, None, 1.0), (98, 5.0, 1.0), (97, 3.0, 3.0)]
    left, right = spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(spans, "s int, lo double, hi double")
    want = sorted(((p, s) for p, at in points if at is not None for s, lo, hi in spans if lo is not None and lo <= at < hi), key=repr)
    found = ranges.interval_join(left, right, F.col("at"), F.col("lo"), F.col("hi"), 5)
    assert rows_of(found, "p", "s") == want and "NestedLoop" not in plan_of(found)


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 5), (4, None, 5), (5, "a", None), (6, "a", 5)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "early", 1), ("a", 5, "tie", 1), ("a", 5, "winner", 2), ("a", 9, "late", 1), (None, 1, "no key", 1), ("b", 3, None, 1), ("a", None, "no time", 1)], "k string, t int, v string, seq int")
    found = ranges.asof_join(left, right, ["k"], "t", "t", ["v"], ["seq"])
    assert rows_of(found, "id", "v") == sorted([(1, "winner"), (2, None), (3, None), (4, None), (5, None), (6, "winner")], key=repr)
    with pytest.raises(ValueError):
        ranges.asof_join(left, right, ["k"], "t", "t", ["t"], ["seq"])


def test_object_of_names(spark):
    rows = spark.createDataFrame([("g", "a", 1, 1), ("g", "a", None, 2), ("g", "b", 3, 1), ("g", None, 4, 1), ("h", "a", 1, 3), ("h", "a", 9, 4)], "g string, k string, v int, seq int")
    assert rows_of(object_agg(rows, ["g"], "k", "v", "seq"), "g", "object") == [("g", '{"a":null,"b":3}'), ("h", '{"a":9}')]
    assert rows_of(object_agg(rows.limit(0), [], "k", "v", "seq"), "object") == [("{}",)]


def test_constraints_and_indexes_of_the_catalog(spark, tmp_path):
    db = Catalog(spark, str(tmp_path))
    db.create("t", spark.createDataFrame([(1, "x"), (2, "x")], "id int, s string"))
    db.add_constraint("t", "unique", "id")
    with pytest.raises(ValueError):
        db.add_constraint("t", "unique", "s")
    with pytest.raises(ValueError):
        db.add_constraint("t", "check", "id < 2")
    assert [tuple(r) for r in db.show_constraints().collect()] == [("t", "unique", "id")]
    db.create_index("by_s", "t", "s")
    assert db.table("t").count() == 2 and [tuple(r) for r in db.show_indexes().collect()] == [("by_s", "t", "s")]
    db.drop_index("by_s")
    assert db.show_indexes().count() == 0

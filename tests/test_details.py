"""Blocks, databases, subscribers and set operations at their edges."""

from __future__ import annotations

import threading

import pytest
from pyspark.errors import AnalysisException

from tidemark.catalog import Databases
from tidemark.operators import procedures
from tidemark.streaming.live import Subscriber


def test_block_leaves_quoted_text_alone():
    assert procedures.block_expression("DECLARE a TEXT := 'x; a'; BEGIN RETURN a || 'a;'; END") == "('x; a') || 'a;'"
    assert procedures.block_query("BEGIN RETURN QUERY SELECT 1 AS a; END") == "SELECT 1 AS a"
    with pytest.raises(ValueError):
        procedures.block_query("BEGIN RETURN 1; END")
    with pytest.raises(ValueError):
        procedures.block_expression("BEGIN RETURN QUERY SELECT 1; END")


def test_procedure_with_semicolon_in_text(spark):
    assert procedures.call(spark, "SELECT 1; SELECT 'a;b' AS t").first()["t"] == "a;b"


def test_databases(spark):
    databases = Databases(spark)
    databases.create("One", "/root/testdata/sf0.001")
    with pytest.raises(KeyError):
        databases.create("one", "/elsewhere")
    assert databases.create("one", "/elsewhere", missing_only=True).folder == "/root/testdata/sf0.001"
    with pytest.raises(ValueError):
        databases.create("../up", "/elsewhere")
    databases.use("ONE")
    assert [tuple(r) for r in databases.show().collect()] == [("one", True)]
    databases.drop("one")
    assert databases.current == "" and databases.show().count() == 0
    databases.drop("one", missing_ok=True)
    with pytest.raises(KeyError):
        databases.drop("one")


def test_subscriber_policies():
    drop, evict, block = Subscriber(2, "drop"), Subscriber(2, "evict"), Subscriber(2, "block", patience=0.05)
    for n in range(4):
        assert drop.post(n) and evict.post(n)
    assert [drop.take() for _ in range(3)] == [0, 1, None]
    assert [evict.take() for _ in range(3)] == [2, 3, None]
    assert block.post(0) and block.post(1) and not block.post(2) and not block.post(3)
    assert [block.take() for _ in range(3)] == [0, 1, None] and not block.post(4)
    with pytest.raises(ValueError):
        Subscriber(1, "wait")


def test_block_policy_waits_for_a_reader():
    one = Subscriber(1, "block", patience=10)
    assert one.post("a")
    reader = threading.Timer(0.05, one.take)
    reader.start()
    assert one.post("b") and one.take() == "b"
    reader.join()


def test_set_operations_need_as_many_columns(spark):
    for word in ("UNION ALL", "UNION", "INTERSECT", "EXCEPT"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT 1 AS a, 2 AS b {word} SELECT 1 AS a")

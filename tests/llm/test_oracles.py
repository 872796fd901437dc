"""Queries whose results SQL can state, against that SQL in another engine."""

from __future__ import annotations

import duckdb
import pytest
from compare import TYPES, duck_rows, spark_rows

from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    frame, relation = queries.queries()[name](spark, FOLDER), duck.sql(queries.oracle_sql()[name])
    assert {c: TYPES[t] for c, t in frame.dtypes} == {c: str(t) for c, t in zip(relation.columns, relation.types)}
    assert spark_rows(frame) == duck_rows(relation)

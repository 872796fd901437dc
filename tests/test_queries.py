"""Every registered query of the engine against its SQL twin in another engine."""

from __future__ import annotations

import duckdb
import pytest
from compare import TYPES, duck_rows, spark_rows

from tidemark.catalog import TABLES
from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def test_each_has_a_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, FOLDER)
    relation = duck.sql(registry.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    assert {c: TYPES.get(t, t) for c, t in frame.dtypes} == {c: str(t) for c, t in zip(relation.columns, relation.types)}
    assert spark_rows(frame) == duck_rows(relation)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_the_library_stands_without_the_corpus_operators(tmp_path):
    """A copy without the corpus package and pipeline still imports and lists its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 150 and 'pipeline' not in n and e.oracle_sql(), n"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})

"""Seeded random predicates and groupings: both engines must agree."""

from __future__ import annotations

import random

import duckdb
import pytest
from compare import duck_rows, spark_rows

from tidemark.catalog import Catalog

FOLDER = "/root/testdata/sf0.001"
NUMBERS = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "lineitem": ["l_orderkey", "l_partkey", "l_quantity", "l_discount"], "customer": ["c_custkey", "c_nationkey", "c_acctbal"]}
TEXTS = {"orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "customer": ["c_name", "c_mktsegment"]}


def predicate(pick: random.Random, table: str, depth: int = 0) -> str:
    kind = pick.randint(0, 7 if depth < 3 else 4)
    n, t = pick.choice(NUMBERS[table]), pick.choice(TEXTS[table])
    simple = [
        f"{n} {pick.choice(['<', '<=', '>', '>=', '=', '<>'])} {pick.randint(0, 200)}", f"{n} BETWEEN {pick.randint(0, 50)} AND {pick.randint(50, 5000)}", f"{t} LIKE '%{pick.choice('AEOFNR1-')}%'",
        f"nullif({t}, '{pick.choice('FORAN')}') IS {pick.choice(['', 'NOT '])}NULL", f"{t} IN ('F', 'O', 'A', 'BUILDING', '{pick.randint(1, 5)}-URGENT')",
    ]
    if kind < 5:
        return simple[kind]
    if kind == 5:
        return f"NOT ({predicate(pick, table, depth + 1)})"
    return f"({predicate(pick, table, depth + 1)} {pick.choice(['AND', 'OR'])} {predicate(pick, table, depth + 1)})"


@pytest.mark.parametrize("seed", range(40))
def test_random_query(spark, seed):
    pick = random.Random(seed)
    table = pick.choice(list(NUMBERS))
    n, t, where = pick.choice(NUMBERS[table]), pick.choice(TEXTS[table]), predicate(pick, table)
    text = pick.choice(
        [
            f"SELECT {n} AS a, {t} AS b FROM {{{table}}} WHERE {where}",
            f"SELECT {t} AS b, count(*) AS n, round(sum({n}), 2) AS s FROM {{{table}}} WHERE {where} GROUP BY {t} HAVING count(*) > {pick.randint(0, 5)}",
            f"SELECT DISTINCT {t} AS b, {n} > 50 AS big FROM {{{table}}} WHERE {where}",
            f"SELECT CASE WHEN {where} THEN 'yes' ELSE 'no' END AS c, count(*) AS n FROM {{{table}}} GROUP BY 1",
        ]
    )
    twin = text.replace(f"{{{table}}}", f"read_parquet('{FOLDER}/{table}.parquet')")
    assert spark_rows(Catalog(spark, FOLDER).sql(text)) == duck_rows(duckdb.sql(twin))

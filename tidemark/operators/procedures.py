"""User-defined functions of all kinds, prepared statements and procedures."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def create_sql_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A scalar function written in SQL, inlined by the optimizer."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def create_table_function(spark: SparkSession, name: str, parameters: str, columns: str, body: str) -> None:
    """A function that returns a table, for use in FROM."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")


def statements(body: str) -> list[str]:
    """The statements of a body; a semicolon within quotes ends none."""
    return [part for part in map(str.strip, re.findall(r"(?:'(?:[^']|'')*'|[^;'])+", body)) if part]


def _block_result(source: str) -> tuple[str, str]:
    """("expression" or "query", SQL) that a straight-line block returns.

    ``source`` is ``DECLARE name TYPE [:= expr]; ... BEGIN name := expr; ... RETURN [QUERY] ...; END``; each assignment is put
    in place of its name in what follows, outside quoted text.
    """
    match = re.fullmatch(r"\s*(?:DECLARE\s+(.*?))?\bBEGIN\b(.*)\bEND\b\s*;?\s*", source, re.S | re.I)
    if not match:
        raise ValueError("a block has the form [DECLARE ...] BEGIN ... END")
    values: dict[str, str] = {}
    put = lambda text: re.sub(r"'(?:[^']|'')*'|\b[A-Za-z_]\w*\b", lambda m: f"({values[m[0].lower()]})" if m[0].lower() in values else m[0], text)
    for part in statements(match[1] or ""):
        name, _, first = part.partition(":=")
        values[name.split()[0].lower()] = put(first.strip()) if first else "NULL"
    for part in statements(match[2]):
        if found := re.fullmatch(r"RETURN\s+(QUERY\s+)?(.*)", part, re.S | re.I):
            return "query" if found[1] else "expression", put(found[2].strip())
        name, _, expression = part.partition(":=")
        values[name.strip().lower()] = put(expression.strip())
    raise ValueError("the block returns nothing")


def block_expression(source: str) -> str:
    """The expression that a block with RETURN computes, for :func:`create_sql_function`."""
    kind, text = _block_result(source)
    if kind != "expression":
        raise ValueError("the block returns a query")
    return text


def block_query(source: str) -> str:
    """The query that a block with RETURN QUERY runs, for :func:`create_table_function`."""
    kind, text = _block_result(source)
    if kind != "query":
        raise ValueError("the block returns an expression")
    return text


def call(spark: SparkSession, body: str, **parameters) -> DataFrame | None:
    """Run statements in order, with :name parameters; the last one's result is the procedure's."""
    result = None
    for statement in statements(body):
        used = {k: v for k, v in parameters.items() if re.search(rf":{k}\b", statement)}
        result = spark.sql(statement, args=used or None)
    return result


class Prepared:
    """A statement with :name parameters, run with other values each time."""

    def __init__(self, run: Callable[..., DataFrame], text: str) -> None:
        self.run, self.text = run, text

    def execute(self, **parameters) -> DataFrame:
        return self.run(self.text, **parameters)

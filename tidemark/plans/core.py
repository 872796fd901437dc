"""How queries are declared: a function of a catalog, and the SQL of the same result for another engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of a catalog; its twin's tables are plain names."""

    def register(build: Callable[[Catalog], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, sf_dir: build(Catalog(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle
        return build

    return register


def both(name: str, text: str, twin: str | None = None, **parameters) -> None:
    """Register SQL in which {name} is a table; ``twin`` is given where the other engine spells it differently."""
    QUERIES[name] = lambda spark, sf_dir: Catalog(spark, sf_dir).sql(text, **parameters)
    ORACLES[name] = twin or re.sub(r"\{(\w+)\}", r"\1", text)

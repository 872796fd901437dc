"""All queries of the engine by name, and their SQL twins."""

from __future__ import annotations

from . import aggregates, changing, details, extended, files_and_streams, joins, scalars, scans, searching, subqueries, windowing  # noqa: F401  (they register)
from .core import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

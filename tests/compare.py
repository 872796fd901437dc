"""Results as sorted rows of plain values, so that two engines can be compared."""

from __future__ import annotations

import math
from decimal import Decimal

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, Decimal):
        return float(value)
    return str(value) if hasattr(value, "isoformat") else value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def spark_rows(frame):
    return rows(frame.columns, [tuple(r) for r in frame.collect()])


def duck_rows(relation):
    return rows(relation.columns, relation.fetchall())

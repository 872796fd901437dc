"""Inserts, updates, deletes, upserts and merges as rewrites of DataFrames.

A table is immutable; each operator returns the table as it is afterwards.  Write the result to a new place or version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    """A condition that is not known is not met."""
    return F.coalesce(condition, F.lit(False))


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Append rows; columns that they lack get a default, else null."""
    for field in table.schema.fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, (defaults or {}).get(field.name, F.lit(None)).cast(field.dataType))
    return table.unionByName(rows.select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields]))


def numbered(table: DataFrame, rows: DataFrame, column: str, order: str) -> DataFrame:
    """Rows to insert with the next numbers of an auto-increment column."""
    from .numbering import row_numbers

    start = table.agg(F.coalesce(F.max(column), F.lit(0)).cast("long")).scalar()
    return row_numbers(rows, order, "next_").withColumn(column, F.col("next_") + start).drop("next_")


def update(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    met = holds(condition)
    return table.withColumns({c: F.when(met, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def update_returning(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The rows that an update changes, before (``old``) and after (``new``)."""
    old = table.where(holds(condition))
    new = F.struct(*[values[c].cast(table.schema[c].dataType).alias(c) if c in values else F.col(c) for c in table.columns])
    return old.select(F.struct(*table.columns).alias("old"), new.alias("new"))


def update_from(table: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Take columns from the source row of the same key, where there is one."""
    new = source.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("found_"))
    joined = table.join(new, keys, "left")
    return joined.select(*[F.when(F.col("found_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def delete(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(~holds(condition))


def delete_returning(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(holds(condition))


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def _one_a_key(rows: DataFrame, keys: list[str], last_by: Column) -> DataFrame:
    """Of the incoming rows of a key the last."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), last_by).alias("row_")).select("row_.*")


def upsert_nothing(table: DataFrame, rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Insert rows whose key is new; of several, the first in ``order`` (a sortable column)."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("row_")).select("row_.*")
    return table.unionByName(first.join(table, keys, "left_anti").select(*table.columns))


def upsert_update(table: DataFrame, rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Insert rows, replacing those of the same key; of several, the last in ``order``."""
    last = _one_a_key(rows, keys, order)
    return table.join(last, keys, "left_anti").unionByName(last.select(*table.columns))


def upsert_set(table: DataFrame, rows: DataFrame, keys: list[str], order: str, values: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE SET with expressions over the row that is there and the incoming (excluded) one.

    ``values(old, excluded)`` gives new values of some columns from two structs.  Several incoming rows of a key act one after the
    other in the order of column ``order``: the first is inserted where the key is new, each further one updates.  The incoming
    rows of one key meet in one task; the table's are joined by key.
    """
    fields = table.schema.fields
    cast = lambda s: F.struct(*[s[f.name].cast(f.dataType).alias(f.name) for f in fields])

    def apply(old: Column, excluded: Column) -> Column:
        new = values(old, excluded)
        return F.struct(*[new.get(f.name, old[f.name]).cast(f.dataType).alias(f.name) for f in fields])

    entry = F.struct(F.col(order).alias("order_"), F.struct(*table.columns).alias("row_"))
    incoming = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("in_"))
    own = table.select(*keys, F.struct(*table.columns).alias("old_"))
    both = own.join(incoming, keys, "full")
    steps = F.transform(F.coalesce("in_", F.array().cast(incoming.schema["in_"].dataType)), lambda e: cast(e["row_"]))
    is_new = F.col("old_").isNull()
    first = F.when(is_new, F.get(steps, F.lit(0))).otherwise(cast(F.col("old_")))
    rest = F.when(is_new, F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0)))).otherwise(steps)
    return both.select(F.aggregate(rest, first, apply).alias("row_")).select("row_.*")


def insert_checked(
    table: DataFrame,
    rows: DataFrame,
    computed: dict[str, Column] | None = None,
    defaults: dict[str, Column] | None = None,
    checks: dict[str, Column] | None = None,
    unique: list[str] = (),
    parents: dict[str, tuple[DataFrame, str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The table after an insert, and the rows that were refused with the names of what they violate.

    Defaults fill nulls, then computed columns are set; ``checks`` refuse what is known to be false; a key ``unique`` must be new and
    occur once (nulls are never equal); ``parents`` gives (table, key) of the columns that refer to another.
    """
    rows = insert(table.limit(0), rows, defaults).withColumns({c: F.coalesce(F.col(c), v.cast(table.schema[c].dataType)) for c, v in (defaults or {}).items()})
    rows = rows.withColumns({c: v.cast(table.schema[c].dataType) for c, v in (computed or {}).items()})
    faults = [F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in (checks or {}).items()]
    faults += [F.when(F.col(f.name).isNull(), F.lit(f"not null {f.name}")) for f in table.schema.fields if not f.nullable]
    seen, at = rows, [F.col(c) for c in table.columns]
    if unique:
        taken = table.select(*unique).distinct().withColumn("taken_", F.lit(True))
        counts = rows.groupBy(*unique).agg(F.count("*").alias("many_"))
        seen = seen.join(counts, list(unique), "left").join(taken, list(unique), "left")
        faults.append(F.when(F.coalesce(F.col("taken_"), F.lit(False)) | (F.coalesce("many_", F.lit(1)) > 1), F.lit("unique")))
    for i, (column, (parent, key)) in enumerate((parents or {}).items()):
        known = parent.select(F.col(key).alias(f"key{i}_")).distinct()
        seen = seen.join(known, F.col(column) == F.col(f"key{i}_"), "left")
        faults.append(F.when(F.col(column).isNotNull() & F.col(f"key{i}_").isNull(), F.lit(f"parent of {column}")))
    judged = seen.select(*at, F.filter(F.array(*faults, F.lit(None).cast("string")), lambda f: f.isNotNull()).alias("violates"))
    return table.unionByName(judged.where(F.size("violates") == 0).drop("violates")), judged.where(F.size("violates") > 0)


def merge(table: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column] | None = None, insert: dict[str, Column] | None = None, delete_when: Column | None = None) -> DataFrame:
    """MERGE by equal keys: one full outer join.

    Expressions refer to the table's columns as ``t.name`` and to the source's as ``s.name``.  A source with several rows of
    a key that the table has is an error when the plan runs, as the result would depend on their order.
    """
    once = source.groupBy(*keys).agg(F.first(F.struct(*source.columns)).alias("row_"), F.count("*").alias("n_"))
    s = once.select(F.when(F.col("n_") > 1, F.raise_error(F.lit("several source rows match one key")).cast(once.schema["row_"].dataType)).otherwise(F.col("row_")).alias("s_")).select("s_.*").withColumn("in_s", F.lit(True))
    t = table.withColumn("in_t", F.lit(True))
    joined = t.alias("t").join(s.alias("s"), [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full")
    matched, only_source = F.col("t.in_t") & F.col("s.in_s"), F.col("t.in_t").isNull()
    kept = F.lit(True)
    if insert is None:
        kept = kept & ~holds(only_source)
    if delete_when is not None:
        kept = kept & ~(holds(matched) & holds(delete_when))
    out = []
    for field in table.schema.fields:
        c = field.name
        new = (insert or {}).get(c, F.col(f"s.{c}") if c in source.columns else F.lit(None))
        value = F.when(holds(only_source), new.cast(field.dataType))
        if update and c in update:
            value = value.when(holds(matched), update[c].cast(field.dataType))
        out.append(value.otherwise(F.col(f"t.{c}")).alias(c))
    return joined.where(kept).select(*out)

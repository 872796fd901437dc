"""Tables by name, with views, row policies and column masks applied wherever a table is resolved."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Mask:
    """Keeps a prefix and a suffix and fills what lies between; values too short for both stay as they are."""

    column: str
    prefix: int = 0
    suffix: int = 0
    fill: str = "*"

    def apply(self, value: Column) -> Column:
        hidden = F.char_length(value) - self.prefix - self.suffix
        # slices by length: left/right take no negative counts
        masked = F.concat(F.left(value, F.lit(self.prefix)), F.repeat(F.lit(self.fill), hidden), F.right(value, F.lit(self.suffix)))
        return F.when(hidden > 0, masked).otherwise(value)


@dataclass
class Catalog:
    """Lazy tables of one folder of Parquet files.  Times are read and shown in UTC."""

    spark: SparkSession
    folder: str
    views: dict[str, str] = field(default_factory=dict)
    policies: dict[str, list[str]] = field(default_factory=dict)
    masks: dict[str, list[Mask]] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    constraints: list[tuple[str, str, str]] = field(default_factory=list)
    indexes: list[tuple[str, str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")

    def create(self, name: str, frame: DataFrame) -> None:
        """Name a DataFrame as a table."""
        self.frames[name.lower()] = frame

    def drop(self, name: str, missing_ok: bool = False) -> None:
        if self.frames.pop(name.lower(), self.views.pop(name.lower(), None)) is None and not missing_ok:
            raise KeyError(name)

    def rename(self, old: str, new: str) -> None:
        self.frames[new.lower()] = self.frames.pop(old.lower())

    def create_view(self, name: str, text: str) -> None:
        """A stored query; tables in it are written {name}."""
        self.views[name.lower()] = text

    def enable_policies(self, table: str, *conditions: str) -> None:
        """Rows pass if any condition holds; with none at all a read of the table is an error."""
        self.policies[table.lower()] = list(conditions)

    def mask(self, table: str, *masks: Mask) -> None:
        self.masks[table.lower()] = list(masks)

    def change(self, name: str, after: DataFrame, returned: DataFrame | None = None, as_: str | None = None) -> None:
        """Put a changed table in place; the rows that the change returns become a table of their own, for the rest of a statement."""
        self.create(name, after)
        if as_ is not None and returned is not None:
            self.create(as_, returned)

    def add_constraint(self, table: str, kind: str, text: str) -> None:
        """ALTER TABLE ADD: ``check`` with a condition, ``unique`` with columns, or ``parent`` with "column -> table.key".

        Rows that break it already are an error.
        """
        broken = self.violations(table, kind, text)
        if not broken.isEmpty():
            raise ValueError(f"rows of {table} break {kind} {text}")
        self.constraints.append((table.lower(), kind, text))

    def violations(self, table: str, kind: str, text: str) -> DataFrame:
        """What breaks a constraint of any kind of :meth:`add_constraint`."""
        from .operators import constraints as found

        rows = self.raw(table)
        if kind == "check":
            return found.check_violations(rows, F.expr(text))
        if kind == "unique":
            return found.unique_violations(rows, [c.strip() for c in text.split(",")])
        if kind == "parent":
            column, _, parent = (x.strip() for x in text.partition("->"))
            other, key = parent.split(".")
            return found.foreign_key_violations(rows, column, self.raw(other), key)
        raise ValueError(kind)

    def create_index(self, name: str, table: str, *columns: str) -> DataFrame:
        """A copy of the table that is sorted by the columns, whose row-group statistics skip what an index would."""
        from .scratch import Scratch

        kept = Scratch(self.spark, "index").save(self.raw(table).repartitionByRange(*columns).sortWithinPartitions(*columns), name)
        self.create(table, kept)
        self.indexes.append((name, table.lower(), ", ".join(columns)))
        return kept

    def drop_index(self, name: str) -> None:
        """Forget an index; the table stays as it lies."""
        self.indexes = [x for x in self.indexes if x[0] != name]

    def show_indexes(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.indexes), "name string, table_name string, columns string")

    def show_constraints(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.constraints), "table_name string, kind string, definition string")

    def raw(self, name: str) -> DataFrame:
        key = name.lower()
        if key in self.views:
            return self.sql(self.views[key])
        return self.frames[key] if key in self.frames else self.spark.read.parquet(f"{self.folder}/{key}.parquet")

    def table(self, name: str) -> DataFrame:
        """The table as a reader may see it: policies first, masks on what remains."""
        key, frame = name.lower(), self.raw(name)
        if key in self.policies:
            if not self.policies[key]:
                raise PermissionError(f"row security is on for {name}, which has no policy")
            allowed = F.lit(False)
            for condition in self.policies[key]:
                allowed = allowed | F.coalesce(F.expr(condition), F.lit(False))
            frame = frame.where(allowed)
        return frame.withColumns({m.column: m.apply(F.col(m.column)) for m in self.masks.get(key, ())})

    def sql(self, text: str, **parameters) -> DataFrame:
        """Run SQL in which {name} is a table and :name a parameter."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, args=parameters or None, **{n: self.table(n) for n in names})

    def show_tables(self) -> DataFrame:
        kinds = [(n, "table") for n in {*TABLES, *self.frames} - {*self.views}] + [(n, "view") for n in self.views]
        return self.spark.createDataFrame(sorted(kinds), "name string, kind string")

    def describe(self, name: str) -> DataFrame:
        """Columns, types and nullability."""
        fields = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(self.table(name).schema.fields)]
        return self.spark.createDataFrame(fields, "position int, name string, type string, nullable boolean")


class Databases:
    """Catalogs by name, each over a folder of its own; one of them is current."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.current = spark, ""
        self.catalogs: dict[str, Catalog] = {}

    def create(self, name: str, folder: str, missing_only: bool = False) -> Catalog:
        key = name.lower()
        if not re.fullmatch(r"[a-z_]\w*", key):
            raise ValueError(f"no name for a database: {name}")
        if key in self.catalogs and not missing_only:
            raise KeyError(f"database {name} exists")
        return self.catalogs.setdefault(key, Catalog(self.spark, folder))

    def drop(self, name: str, missing_ok: bool = False) -> None:
        """Forget a database; its files stay.  If it was current, none is."""
        if self.catalogs.pop(name.lower(), None) is None and not missing_ok:
            raise KeyError(name)
        if self.current == name.lower():
            self.current = ""

    def use(self, name: str) -> Catalog:
        found = self.catalogs[name.lower()]
        self.current = name.lower()
        return found

    def show(self) -> DataFrame:
        return self.spark.createDataFrame([(n, n == self.current) for n in sorted(self.catalogs)], "name string, current boolean")

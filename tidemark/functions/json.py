"""JSON held as text: paths, containment, merge and construction, over maps that Catalyst can prune and fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = "map<string,string>"


def as_map(value: Column) -> Column:
    """Top-level keys and their values as text; null if the text is no object."""
    return F.from_json(value, MAP)


def get(value: Column, key: str) -> Column:
    """The value of a key as text (strings without quotes); null if there is none."""
    return F.get_json_object(value, f"$['{key}']")


def extract_path(value: Column, *steps: str | int) -> Column:
    """Follow keys and array places."""
    return F.get_json_object(value, "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps))


def contains(value: Column, other: Column) -> Column:
    """Whether each top-level key of ``other`` has the same value in ``value``."""
    a, b = as_map(value), as_map(other)
    return F.coalesce(F.forall(F.map_entries(b), lambda e: F.coalesce(F.element_at(a, e["key"]) == e["value"], F.lit(False))), F.lit(False))


def array_contains_all(value: Column, other: Column) -> Column:
    """Whether each element of one JSON array is in another, by text."""
    return F.size(F.array_except(F.from_json(other, "array<string>"), F.from_json(value, "array<string>"))) == 0


def has_key(value: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(value), F.lit(key)), F.lit(False))


def merge(value: Column, other: Column) -> Column:
    """Shallow merge as a map; the right value wins."""
    a, b = as_map(value), as_map(other)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def set_key(value: Column, key: str, new: Column) -> Column:
    """The map with one top-level key set."""
    return F.map_concat(F.map_filter(as_map(value), lambda k, _: k != key), F.create_map(F.lit(key), new.cast("string")))


def kind_of(value: Column) -> Column:
    """null, boolean, number, string, array or object; text that is no JSON is a string."""
    head = F.left(F.ltrim(value), F.lit(1))
    return (
        F.when(head == "{", "object").when(head == "[", "array").when(head == '"', "string").when(F.trim(value).isin("true", "false"), "boolean")
        .when(F.trim(value) == "null", "null").when(F.try_to_number(F.trim(value), F.lit("S999999999999999999.999999999")).isNotNull() | F.trim(value).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number")
        .otherwise("string")
    )


def build_object(**values: Column) -> Column:
    """An object with its keys in order."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


def build_array(*values: Column) -> Column:
    return F.to_json(F.array(*values))


def first_element(value: Column) -> Column:
    return F.get_json_object(value, "$[0]")


def elements(value: Column) -> Column:
    """The elements as an array of texts, to explode."""
    return F.from_json(value, "array<string>")


def object_agg(rows: DataFrame, keys: list[str], name: str, value: str, order: str) -> DataFrame:
    """JSON_OBJECT_AGG: ``keys`` and an ``object`` of names and values as text, names in order.

    Of a repeated name the last value by ``order`` stays, found by an aggregation with map-side combining before objects are made;
    null names are left out, and no rows without keys make an empty object.
    """
    last = rows.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.max_by(F.struct(value), order).alias("last_"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("k"), F.col(f"last_.{value}").alias("v"))))
    return last.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("object"))

"""String functions whose treatment of nulls and bounds differs from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_all(*parts: Column) -> Column:
    """Concatenation in which null is the empty string."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def char_count(value: Column) -> Column:
    """Characters; null has none."""
    return F.coalesce(F.char_length(value), F.lit(0))


def substr(value: Column, start: int, length: int | None = None) -> Column:
    """From a 1-based start; a start before the first character is the first, and nothing lies beyond the end."""
    at = max(start, 1)
    return F.substring(value, at, length if length is not None else 2**31 - 1 - at)


def trim_space(value: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def ltrim_space(value: Column) -> Column:
    return F.ltrim(value, F.lit(" \t\r\n"))


def rtrim_space(value: Column) -> Column:
    return F.rtrim(value, F.lit(" \t\r\n"))


def position(part: Column, value: Column) -> Column:
    """1-based place of the first occurrence, 0 if there is none."""
    return F.coalesce(F.call_function("locate", part, value), F.lit(0))


def capitalised(value: Column) -> Column:
    """Words joined by single spaces, each lower-cased but for a first letter a-z in upper case."""
    words = F.filter(F.split(F.lower(value), r"\s+"), lambda w: w != "")
    first = lambda w: F.translate(F.left(w, F.lit(1)), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.array_join(F.transform(words, lambda w: F.concat(first(w), F.substr(w, F.lit(2)))), " ")

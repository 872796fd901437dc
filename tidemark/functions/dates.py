"""Date and time functions over timestamps without a zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")
#: SQL format tokens and Spark's patterns (fixed values), longest first.
TOKENS = (("YYYY", "yyyy"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("AM", "a"), ("PM", "a"))


def pattern(sql_format: str) -> str:
    """Spark's datetime pattern for a SQL format."""
    table = dict(TOKENS)
    return re.sub("|".join(t for t, _ in TOKENS), lambda m: table[m[0]], sql_format)


def to_date(value: Column, sql_format: str) -> Column:
    return F.to_date(value, pattern(sql_format))


def to_timestamp(value: Column, sql_format: str) -> Column:
    return F.to_timestamp(value, pattern(sql_format)).cast("timestamp_ntz")


def to_char(value: Column, sql_format: str) -> Column:
    return F.date_format(value, pattern(sql_format))


def current_time() -> Column:
    """The time of day in UTC (the session's zone), as HH:MM:SS."""
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def trunc(part: str, value: Column) -> Column:
    """Start of the year, month, day, hour, minute or second, without a zone."""
    return F.date_trunc(part, value).cast("timestamp_ntz")


def extract(field: str, value: Column) -> Column:
    """YEAR to SECOND, DOW (0 is Sunday), DOY or EPOCH, as a whole number."""
    by_name = {
        "YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DOY": F.dayofyear,
        "DOW": lambda c: F.dayofweek(c) - 1, "EPOCH": lambda c: F.unix_timestamp(c.cast("timestamp")),
    }
    return by_name[field.upper()](value).cast("long")


def add(value: Column, number: int, unit: str) -> Column:
    """Shift by whole units; a day beyond the end of the month becomes its last."""
    return F.timestamp_add(unit.upper(), F.lit(number), value)


def subtract(value: Column, number: int, unit: str) -> Column:
    return add(value, -number, unit)


def diff(unit: str, first: Column, second: Column) -> Column:
    """Complete units from the first to the second."""
    return F.timestamp_diff(unit.upper(), first, second)


def age(later: Column, earlier: Column) -> Column:
    """'D days H hours M mins S secs' between two times."""
    seconds = F.timestamp_diff("SECOND", earlier, later)
    whole = lambda by: (seconds / F.lit(by)).cast("long")  # noqa: E731  towards zero, as the remainders are
    return F.format_string("%d days %d hours %d mins %d secs", whole(86400), whole(3600) % 24, whole(60) % 60, seconds % 60)


def shift_text(value: Column, amount: str) -> Column:
    """value + 'n unit(s)', as in '3 days' or '-1 month'."""
    number, unit = re.fullmatch(r"\s*([+-]?\d+)\s+([A-Za-z]+?)s?\s*", amount).groups()
    return add(value, int(number), unit)

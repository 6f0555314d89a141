"""Scalar functions of the warehouse, as column expressions.

Strings of time are 'yyyy-MM-dd HH:mm:ss' in the session's time zone, which jobs set and transforms never do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
#: What a keyword is: a run of ASCII letters and digits, or a single Han character.
KEYWORD = r"[a-z0-9]+|\p{IsHan}"


def millis(text: Column, fallback: Column | None = None) -> Column:
    """Epoch milliseconds of a time string; fallback (or null) for one that doesn't parse."""
    parsed = F.unix_millis(F.try_to_timestamp(text, F.lit(TIME_FORMAT)))
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def event_time(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def event_time_seconds(ms: Column) -> Column:
    """Event time with milliseconds dropped, as the SQL tables declare it."""
    return F.timestamp_seconds(F.floor(ms / 1000))


def time_text(ts: Column) -> Column:
    return F.date_format(ts, TIME_FORMAT)


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def date_part(text: Column) -> Column:
    """'yyyy-MM-dd' of a time string; null if there is none."""
    return F.get(F.split(text, " "), F.lit(0))


def hour_part(text: Column) -> Column:
    """'HH' of a time string; null if it has no time."""
    return F.get(F.split(F.get(F.split(text, " "), F.lit(1)), ":"), F.lit(0))


def blank(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (F.length(c) == 0)


def age(birthday: Column, as_of: Column) -> Column:
    """Whole years of 365 days from birthday (text) to as_of; 0 for a birthday that doesn't parse."""
    born = F.to_date(F.try_to_timestamp(birthday, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.floor(F.datediff(as_of, born) / 365), F.lit(0)).cast("int")


def as_long(c: Column) -> Column:
    """A lenient getter: numbers and strings of numbers; null for anything else."""
    return c.try_cast(T.LongType())


def as_money(c: Column) -> Column:
    return c.try_cast(T.DecimalType(16, 2))


def routing_key(table: Column, kind: Column) -> Column:
    return F.concat_ws(":", table, kind)


def first_non_null(*cs: Column) -> Column:
    return F.coalesce(*cs)


def keywords(text: Column) -> Column:
    """The keywords of a phrase, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(0))


def camel(name: str) -> str:
    """order_id -> orderId."""
    head, *rest = name.lower().split("_")
    return head + "".join(x.capitalize() for x in rest)

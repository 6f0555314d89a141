"""Visits: the first of a day, and bounces. Batch forms; streaming/processors.py has the streams'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemart.functions.scalars import blank, day_text, event_time
from tidemart.operators.patterns import Pattern, matched


def is_entry(last_page_id: Column) -> Column:
    """A page that no other page led to."""
    return blank(last_page_id)


def unique_visits(pages: DataFrame, *tiebreak: str) -> DataFrame:
    """pages (common, page, ts): the first entry page of each mid and day, by ts (then tiebreak). Rows without mid or ts are dropped."""
    w = Window.partitionBy("common.mid", "_day").orderBy("ts", *tiebreak)
    entries = pages.where(is_entry(F.col("page.last_page_id")) & F.col("common.mid").isNotNull() & F.col("ts").isNotNull())
    first = entries.withColumn("_day", day_text(event_time(F.col("ts")))).withColumn("_n", F.row_number().over(w))
    return first.where("_n = 1").drop("_n", "_day")


def user_jumps(pages: DataFrame, *tiebreak: str, within_ms: int = 10_000) -> DataFrame:
    """pages (common, page, ts): entry pages that the visitor left at once. An entry page counts if the mid's next page comes within_ms later or more,
    not at all, or is an entry page itself: matches of bounce() and those that time out."""
    columns = pages.columns
    marked = pages.withColumns({"_mid": F.col("common.mid"), "_entry": is_entry(F.col("page.last_page_id"))})
    pattern = Pattern((("_entry", 2),), within_ms)
    return matched(marked, pattern, "_mid", "ts", *tiebreak).select(*columns)

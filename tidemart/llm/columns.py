"""Small column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, however often (and in whatever lambda) body uses it."""
    return F.transform(F.array(value), body)[0]


def positions(size: Column) -> Column:
    """array(0, ..., size - 1); empty for 0."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def fresh(name: str, columns: list[str]) -> str:
    """name, or with underscores after it what none of columns is called, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name

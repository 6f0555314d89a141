"""Order of changes: where a record stands in its source, as one comparable column.

A position is (major, log, pos, row), compared in that order. A change record that names its place in the database's log has that
(length of the log file's name, its name, offset, row): however often, late or in whatever batch it comes, it is the same. Other
records have the place in their topic: the offset in Kafka, where a key's records share a partition; in file topics the file's
time, its path and the line. Positions of the two kinds aren't comparable, so a table's changes should be of one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEQ = "struct<major: bigint, log: string, pos: bigint, row: bigint>"
#: What a change record says of its place in the log.
SOURCE = "struct<file: string, pos: bigint, row: bigint>"
Position = tuple[int, str, int, int]
#: Before all positions.
FIRST: Position = (-1, "", 0, 0)


def position(major: Column | int, log: Column | str, pos: Column | int, row: Column | int = 0) -> Column:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    kinds = (("major", major, "bigint"), ("log", log, "string"), ("pos", pos, "bigint"), ("row", row, "bigint"))
    return F.struct(*[as_column(c).cast(kind).alias(name) for name, c, kind in kinds])


def at(p: Position) -> Column:
    """A constant."""
    return position(*p)


def numbered(seq: Column) -> Column:
    """A plain number as a position."""
    return position(0, "", seq)


def in_kafka() -> Column:
    return position(0, "", F.col("offset"))


def in_files(line: Column) -> Column:
    """line: its number in the file."""
    m = F.col("_metadata")
    return position(F.unix_millis(m["file_modification_time"]), m["file_path"], line)


def in_log(source: Column) -> Column:
    """Null unless the record names a log file and an offset. Files' names end in a growing number: longer names are later."""
    known = source["file"].isNotNull() & source["pos"].isNotNull()
    return F.when(known, position(F.length(source["file"]), source["file"], source["pos"], F.coalesce(source["row"], F.lit(0))))

"""Intermediate tables that outlive lost executors: Parquet below the folder in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in spark.checkpoint.dir. Where a session names none, a local master (one
    process on one machine, as in tests) gets a temporary one; any other raises, since nothing tells what its executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tidemart-"))
        return _own[0]
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/tidemart-{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


class Scope:
    """Tables written while it is the innermost scope. At its end all go but those kept, which pass to the scope around it."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, a table made by written(), outlives the scope."""
        self.kept += [p for p in self.paths if p == getattr(df, "_scratch_path", None)]
        return df


#: The scopes that are open, of this thread (or task of an event loop) alone.
_scopes: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Frees what is written inside as soon as nothing reads it any more: at the end. Frames made inside must not be run after that, unless
    all tables that they read are kept."""
    own = Scope()
    around = _scopes.get()
    _scopes.set((*around, own))
    try:
        yield own
    finally:
        _scopes.set(around)
        if around:
            around[-1].paths += own.kept
        for path in set(own.paths) - set(own.kept):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    if _scopes.get():
        _scopes.get()[-1].paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes the files of a table made by written() that nothing reads any more."""
    _delete(df.sparkSession, df._scratch_path)


def small(df: DataFrame, rows: int = 1 << 22) -> DataFrame:
    """df, a written table of narrow rows, to be broadcast if it has at most so many rows; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it lasts, Python tasks of jobs that begin get texts in batches of so many rows: what they hold at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)

"""Sinks. Those of streams are functions for foreachBatch: a batch that is replayed writes the same files again, not more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.functions import order
from tidemart.operators.dims import as_table, folded, fresh

Batch = Callable[[DataFrame, int], None]


def _place(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id:012d}"


def topic_sink(topic: str, root: str | None = None, **kafka: str) -> Batch:
    """Rows (value) to one topic: Kafka, at least once, or the file topic below root, once."""

    def write(df: DataFrame, batch_id: int) -> None:
        if root:
            df.select("value").write.mode("overwrite").text(_place(f"{root}/{topic}", batch_id))
        else:
            df.select("value").write.format("kafka").options(topic=topic, **kafka).save()

    return write


def routed_sink(root: str | None = None, default: str = "unrouted", **kafka: str) -> Batch:
    """Routed changes to the topics that sink_table names; the payload is after as JSON."""

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df.select(F.coalesce("sink_table", F.lit(default)).alias("topic"), F.to_json("after").alias("value"))
        if root:
            rows.withColumnRenamed("topic", "sink_table").write.mode("overwrite").partitionBy("sink_table").text(_place(root, batch_id))
        else:
            rows.write.format("kafka").options(**kafka).save()

    return write


def table_sink(path: str) -> Batch:
    return lambda df, batch_id: df.write.mode("overwrite").parquet(_place(path, batch_id))


def jdbc_sink(url: str, table: str, columns: list[str], batchsize: int = 5000, **options: str) -> Batch:
    """Rows by column name, transient columns left out; at least once. sources/jdbc.py has the sink that writes each once."""

    def write(df: DataFrame, _: int) -> None:
        df.select(*columns).write.format("jdbc").options(url=url, dbtable=table, batchsize=batchsize, **options).mode("append").save()

    return write


def console_sink(n: int = 20) -> Batch:
    return lambda df, _: df.show(n, truncate=False)


def without_transient(df: DataFrame) -> DataFrame:
    """df without the columns that serve only computation: those whose names begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def fan_out(*sinks: tuple[Callable[[DataFrame], DataFrame], Batch]) -> Batch:
    """One batch to several sinks, each of a part of it; the batch is computed once."""

    def write(df: DataFrame, batch_id: int) -> None:
        kept = df.persist()
        try:
            for part, sink in sinks:
                sink(part(kept), batch_id)
        finally:
            kept.unpersist()

    return write


_SEEN = "last timestamp, on_time bigint, late bigint, batch string"


def late_split(root: str, delay: str, on_time: Batch, late: Batch) -> Batch:
    """Rows (et) by whether they come before the watermark of the batches before, as a stateful step after it would see them: those not later than it
    are late. Rows without et are late. What was seen up to each batch is kept below root, with its counts of both, so a replayed batch is split alike."""

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        seen = _read(spark, f"{root}/seen", _SEEN)
        before = seen.where(F.col("batch") == f"{batch_id - 1:012d}")  # one folder is read: it knows all before it
        if before.isEmpty():
            before = seen.where(F.col("batch") < f"{batch_id:012d}")
        last, mark = before.agg(F.max("last").alias("last")).select("last", (F.col("last") - F.expr(f"INTERVAL {delay}")).alias("mark")).first()
        fits = F.col("et").isNotNull() if mark is None else F.coalesce(F.col("et").cast("timestamp") > F.lit(mark), F.lit(False))
        flag = fresh("_fits", set(df.columns))
        kept = df.withColumn(flag, fits).persist()
        try:
            on_time(kept.where(F.col(flag)).drop(flag), batch_id)
            late(kept.where(~F.col(flag)).drop(flag), batch_id)
            newest = F.greatest(F.max(F.col("et").cast("timestamp")), F.lit(last).cast("timestamp"))
            counts = kept.agg(newest.alias("last"), F.count(F.when(F.col(flag), 1)).alias("on_time"), F.count(F.when(~F.col(flag), 1)).alias("late"))
            counts.write.mode("overwrite").parquet(_place(f"{root}/seen", batch_id))
        finally:
            kept.unpersist()

    return write


def late_counts(spark: SparkSession, root: str) -> DataFrame:
    """batch, on_time, late of a late_split()."""
    return _read(spark, f"{root}/seen", _SEEN).select(F.col("batch").cast("bigint").alias("batch"), "on_time", "late")


# Dimension tables -----------------------------------------------------------------------------------------------------
# A dimension is its history of changes (pk, seq, values), one folder a batch below changes/batch=.../sink_table=... Writing costs what the batch
# holds, not what the table holds; replaying a batch overwrites its own folder. Once in a number of batches the sink folds all before the batch
# into a state below states/, which is never written again once a row below marks/ says that it is whole. Readers fold the newest whole
# state and the batches since. What counts is a change's place in its source (seq), not the batch that brought it, so a state keeps each value's seq.

_CHANGES = f"pk string, seq {order.SEQ}, values map<string,string>, sink_table string, batch string"
_STATES = f"pk string, seq {order.SEQ}, values map<string,string>, sink_table string, until string"


def dim_sink(root: str, every: int = 100) -> Batch:
    """Routed dimension changes (sink_table, sink_pk, after, seq: a position, or a number). Each every-th batch folds the past (never, if every
    is 0). Raises if changes come without seq: their order would be left to chance."""

    def write(df: DataFrame, batch_id: int) -> None:
        if "seq" not in df.columns:
            raise ValueError("changes of dimensions need seq, as topic_source, normalized and snapshot_source give it")
        seq = F.col("seq") if isinstance(df.schema["seq"].dataType, T.StructType) else order.numbered(F.col("seq"))
        rows = df.select("sink_table", F.try_element_at("after", F.col("sink_pk")).alias("pk"), seq.alias("seq"), F.col("after").alias("values"))
        rows.where("pk IS NOT NULL").write.mode("overwrite").partitionBy("sink_table").parquet(_place(f"{root}/changes", batch_id))
        if every and batch_id and batch_id % every == 0:
            settle(df.sparkSession, root, batch_id)

    return write


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was written so far
        return spark.createDataFrame([], schema)


def settled(spark: SparkSession, root: str, until: int | None = None) -> int:
    """Before which batch the newest whole state ends that goes no further than until; 0 if there is none."""
    marks = _read(spark, f"{root}/marks", "batch bigint")
    return (marks if until is None else marks.where(F.col("batch") <= until)).agg(F.max("batch")).first()[0] or 0


def dim_changes(spark: SparkSession, root: str, until: int | None = None) -> DataFrame:
    """pk, seq, values, sink_table: what folds to the dimensions as they are, or were before batch until."""
    columns = ["pk", "seq", "values", "sink_table"]
    since = settled(spark, root, until)
    rows = _read(spark, f"{root}/changes", _CHANGES).where(F.col("batch") >= f"{since:012d}")  # folders before aren't read
    if until is not None:
        rows = rows.where(F.col("batch") < f"{until:012d}")
    if not since:
        return rows.select(columns)
    return spark.read.schema(_STATES).parquet(f"{root}/states").where(F.col("until") == f"{since:012d}").select(columns).union(rows.select(columns))


def _state(changes: DataFrame) -> DataFrame:
    """changes folded, all tables at once: a row for each key and position that some value of it still has."""
    cells = changes.select("sink_table", "pk", "seq", F.explode("values").alias("k", "v"))
    newest = cells.groupBy("sink_table", "pk", "k").agg(F.max_by(F.struct("v"), F.struct("seq", "v")).alias("c"), F.max("seq").alias("seq"))
    values = F.map_from_entries(F.collect_list(F.struct("k", F.col("c.v").alias("v")))).alias("values")  # at most a row's columns
    return newest.groupBy("sink_table", "pk", "seq").agg(values).select("pk", "seq", "values", "sink_table")


def settle(spark: SparkSession, root: str, until: int) -> None:
    """Folds the batches before until, unless that was done: reads the state before and the batches since. Batches so folded may be removed."""
    if settled(spark, root, until) < until:
        _state(dim_changes(spark, root, until)).write.mode("overwrite").partitionBy("sink_table").parquet(f"{root}/states/until={until:012d}")
        spark.range(until, until + 1).select(F.col("id").alias("batch")).coalesce(1).write.mode("append").parquet(f"{root}/marks")


def dim_schema(columns: str, pk: str | None = None) -> T.StructType:
    """The table that a routing row asks for: each column of its comma-separated list a string, the key (default id) not null."""
    key = pk or "id"
    names = columns.split(",")
    return T.StructType([T.StructField(c, T.StringType(), c != key) for c in names if c])


def ensure_dim_table(spark: SparkSession, name: str, columns: str, pk: str | None = None, extend: str | None = None) -> None:
    """Creates the table in the session's catalog unless it is there; extend is appended to the statement."""
    fields = ", ".join(f"`{f.name}` STRING" + ("" if f.nullable else " NOT NULL") for f in dim_schema(columns, pk))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet {extend or ''}")


def dim_snapshot(spark: SparkSession, root: str, table: str, columns: str, pk: str | None = None) -> DataFrame:
    """A dimension as it is now; read it anew in each batch to see updates."""
    rows = dim_changes(spark, root).where(F.col("sink_table") == table)
    return as_table(folded(rows), columns.split(","), pk or "id")


def compact(spark: SparkSession, root: str, until: int, to: str) -> None:
    """Writes the fold of the batches before until, as one batch of a new root; copy later batches beside it and switch readers over."""
    _state(dim_changes(spark, root, until)).write.mode("overwrite").partitionBy("sink_table").parquet(_place(f"{to}/changes", until - 1))

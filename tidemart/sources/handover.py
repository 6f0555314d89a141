"""From a table's rows to its log without a gap: chunks of the table are read between two positions of the log.

A table that changes while it is loaded is cut into ranges of its key. load() reads one after the other and notes the log's position
before (low) and after (high). Of a chunk's rows those stay that the log doesn't change in between, so each is the row as it was
at low; of the log's changes those stay that come after the low mark of their key's chunk. Together they are each change once.

    <place>/rows/chunk=...    rows of a chunk; overwritten if it has to be read again
    <place>/marks/chunk=...   its marks, written when its rows are whole: a load that starts anew goes on after the last

A chunk is read by as many tasks as read() likes; chunks follow each other, so that the log has little time to change one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.functions import order


@dataclass(frozen=True)
class Chunks:
    """Keys first to last in ranges of width: what a table holds when its load begins. Keys outside come by the log alone."""

    first: int
    last: int
    width: int

    def of(self, pk: Column) -> Column:
        """Number of a key's chunk; null outside."""
        return F.when(pk.between(self.first, self.last), F.floor((pk - self.first) / self.width).cast("int"))

    def __len__(self) -> int:
        return max(0, -(-(self.last + 1 - self.first) // self.width))

    def bounds(self, chunk: int) -> tuple[int, int]:
        """First and last key."""
        low = self.first + chunk * self.width
        return low, min(low + self.width - 1, self.last)


_MARKS = f"low {order.SEQ}, high {order.SEQ}, chunk int"


def marks(spark: SparkSession, place: str) -> DataFrame:
    """chunk, low, high of the chunks that are whole."""
    try:
        return spark.read.schema(_MARKS).parquet(f"{place}/marks").select("chunk", "low", "high")
    except AnalysisException:  # none so far
        return spark.createDataFrame([], "chunk int, low " + order.SEQ + ", high " + order.SEQ)


def load(spark: SparkSession, place: str, chunks: Chunks, read: Callable[[int, int], DataFrame], position: Callable[[], order.Position]) -> None:
    """Reads the chunks that aren't whole yet. read(first, last): rows with keys from first to last; position(): the log's end now."""
    whole = {r.chunk for r in marks(spark, place).collect()}  # a row for millions of the table's
    for chunk in range(len(chunks)):
        if chunk not in whole:
            low = position()
            read(*chunks.bounds(chunk)).write.mode("overwrite").parquet(f"{place}/rows/chunk={chunk}")
            both = spark.range(1).select(order.at(low).alias("low"), order.at(position()).alias("high"))
            both.coalesce(1).write.mode("overwrite").parquet(f"{place}/marks/chunk={chunk}")


def jdbc_reader(spark: SparkSession, url: str, table: str, key: str, tasks: int = 8, **options: str) -> Callable[[int, int], DataFrame]:
    """read() of load() for a database table: a chunk's keys are shared by so many tasks."""

    def read(first: int, last: int) -> DataFrame:
        chunk = f"(SELECT * FROM {table} WHERE {key} BETWEEN {first} AND {last}) chunk"
        parts = {"partitionColumn": key, "lowerBound": str(first), "upperBound": str(last + 1), "numPartitions": str(tasks)}
        return spark.read.format("jdbc").options(url=url, dbtable=chunk, **parts, **options).load()

    return read


def loaded(spark: SparkSession, place: str) -> DataFrame:
    """Rows of the chunks that are whole, with chunk."""
    rows = spark.read.option("basePath", f"{place}/rows").parquet(f"{place}/rows/*")
    return rows.join(marks(spark, place).select("chunk"), "chunk", "left_semi")


def undisturbed(rows: DataFrame, marks_: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """rows (key, chunk, ...) that no change of log (key, seq) touched while their chunk was read, with seq: their chunk's low mark."""
    m = marks_.select("chunk", F.col("low").alias("_low"), F.col("high").alias("_high"))
    held = rows.join(m, "chunk")
    touched = log.select(F.col(key).alias("_touched"), F.col("seq").alias("_seq"))
    meanwhile = (F.col(key) == F.col("_touched")) & (F.col("_seq") > F.col("_low")) & (F.col("_seq") <= F.col("_high"))
    return held.join(touched, meanwhile, "left_anti").withColumn("seq", F.col("_low")).drop("_low", "_high", "chunk")


def since(log: DataFrame, marks_: DataFrame, chunks: Chunks, key: str, begun: order.Position) -> DataFrame:
    """Changes of log (key, seq, ...; a table or a stream) that the loaded rows don't show yet: those after the low mark of their key's chunk, or after
    begun, the log's position when the load began, if the key is in none. For when all chunks are loaded."""
    m = marks_.select(F.col("chunk").alias("_chunk"), F.col("low").alias("_low"))
    met = log.withColumn("_of", chunks.of(F.col(key).try_cast("bigint"))).join(m, F.col("_of") == F.col("_chunk"), "left")
    return met.where(F.col("seq") > F.coalesce("_low", order.at(begun))).drop("_of", "_chunk", "_low")


def handed_over(rows: DataFrame, marks_: DataFrame, log: DataFrame, chunks: Chunks, key: str, begun: order.Position) -> DataFrame:
    """key, seq, type and the columns that rows and log share: rows of the snapshot as 'insert', then the changes of log (with type). After-images
    of updates are whole rows, as change logs have them: an update that came while its row was read stands for the row."""
    first = undisturbed(rows, marks_, log, key).withColumn("type", F.lit("insert"))
    after = since(log, marks_, chunks, key, begun)
    columns = [c for c in first.columns if c in after.columns]
    return first.select(columns).unionByName(after.select(columns))


def state(changes: DataFrame, key: str) -> DataFrame:
    """The rows that are there after all changes (key, seq, type, ...): the last of each key, unless it is a delete."""
    whole = F.struct(*[c for c in changes.columns if c not in (key, "seq")])
    last = changes.groupBy(key).agg(F.max_by(whole, "seq").alias("r"))
    return last.where("r.type <> 'delete'").select(key, "r.*").drop("type")

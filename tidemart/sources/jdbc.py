"""Rows into a database table by JDBC, each once.

Tasks write a batch's rows into a staging table, marked with the batch, this try of it, their partition and their own task's number; a
task's rows are there whole or not at all. Then one transaction moves them into the table and notes the batch in a ledger. Whatever fails
before leaves the table as it was; of a partition that two tasks wrote (one retried, or run twice on suspicion) the first task's rows count; a
batch that the ledger knows is left alone. The staging table keeps nothing of batches that are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIZED, _SCALED = ("CHAR", "VARCHAR", "VARBINARY", "BINARY"), ("DECIMAL", "NUMERIC")


@contextmanager
def transaction(spark: SparkSession, url: str, driver: str | None = None, **properties: str) -> Iterator:
    """A connection of the driver's that commits at the end, or rolls back."""
    jvm = spark.sparkContext._jvm
    if driver:
        jvm.java.lang.Class.forName(driver)
    p = jvm.java.util.Properties()
    for k, v in properties.items():
        p.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, p)
    try:
        connection.setAutoCommit(False)
        yield connection
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def execute(connection, sql: str, *values: str | int) -> int:
    statement = connection.prepareStatement(sql)
    try:
        for i, v in enumerate(values, 1):
            statement.setString(i, v) if isinstance(v, str) else statement.setLong(i, v)
        return statement.executeUpdate()
    finally:
        statement.close()


def exists(connection, sql: str, *values: str | int) -> bool:
    statement = connection.prepareStatement(sql)
    try:
        for i, v in enumerate(values, 1):
            statement.setString(i, v) if isinstance(v, str) else statement.setLong(i, v)
        return statement.executeQuery().next()
    finally:
        statement.close()


def column_types(connection, table: str, columns: list[str]) -> list[str]:
    """SQL types of a table's columns."""
    statement = connection.prepareStatement(f"SELECT {', '.join(columns)} FROM {table} WHERE 1 = 0")
    try:
        m, out = statement.executeQuery().getMetaData(), []
        for i in range(1, m.getColumnCount() + 1):
            name = m.getColumnTypeName(i)
            if name.upper() in _SIZED:
                name += f"({m.getPrecision(i)})"
            elif name.upper() in _SCALED:
                name += f"({m.getPrecision(i)}, {m.getScale(i)})"
            out.append(name)
        return out
    finally:
        statement.close()


def _has(connection, table: str) -> bool:
    names = connection.getMetaData().getTables(None, None, None, None)
    while names.next():
        if names.getString("TABLE_NAME").upper() == table.rpartition(".")[2].upper():
            return True
    return False


class OnceSink:
    """A function for foreachBatch. query names the stream: its batches are numbered from 0 by its own checkpoint. Rows are bound to columns by name."""

    def __init__(self, url: str, table: str, columns: list[str], query: str, batchsize: int = 5000, driver: str | None = None, **properties: str) -> None:
        self.url, self.table, self.columns, self.query = url, table, columns, query
        self.staging, self.ledger = f"{table}_staging", f"{table}_batches"
        self.batchsize, self.driver, self.properties = batchsize, driver, properties

    def _transaction(self, spark: SparkSession):
        return transaction(spark, self.url, self.driver, **self.properties)

    def prepare(self, spark: SparkSession) -> None:
        """Makes the staging table and the ledger, unless they are there."""
        with self._transaction(spark) as c:
            if not _has(c, self.staging):
                own = ", ".join(f"{n} {t}" for n, t in zip(self.columns, column_types(c, self.table, self.columns), strict=True))
                execute(c, f"CREATE TABLE {self.staging} ({own}, s_query VARCHAR(200), s_batch BIGINT, s_try VARCHAR(40), s_part BIGINT, s_task BIGINT)")
            if not _has(c, self.ledger):
                execute(c, f"CREATE TABLE {self.ledger} (s_query VARCHAR(200) NOT NULL, s_batch BIGINT NOT NULL, PRIMARY KEY (s_query, s_batch))")

    def done(self, spark: SparkSession, batch_id: int) -> bool:
        with self._transaction(spark) as c:
            return exists(c, f"SELECT 1 FROM {self.ledger} WHERE s_query = ? AND s_batch = ?", self.query, batch_id)

    def stage(self, df: DataFrame, batch_id: int, attempt: str) -> None:
        rows = df.select(*self.columns)
        schema = T.StructType([*rows.schema, T.StructField("s_part", T.LongType()), T.StructField("s_task", T.LongType())])

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get()
            for b in batches:
                own = [pa.array([x] * b.num_rows, pa.int64()) for x in (task.partitionId(), task.taskAttemptId())]
                yield pa.RecordBatch.from_arrays([*b.columns, *own], names=schema.names)

        names = {"s_query": F.lit(self.query), "s_batch": F.lit(batch_id).cast("long"), "s_try": F.lit(attempt)}
        options = {"url": self.url, "dbtable": self.staging, "batchsize": self.batchsize, **({"driver": self.driver} if self.driver else {}), **self.properties}
        rows.mapInArrow(marked, schema).withColumns(names).write.format("jdbc").options(**options).mode("append").save()

    def move(self, spark: SparkSession, batch_id: int, attempt: str) -> None:
        names = ", ".join(self.columns)
        with self._transaction(spark) as c:
            execute(c, f"INSERT INTO {self.ledger} VALUES (?, ?)", self.query, batch_id)  # its key keeps a second driver from moving too
            first = f"SELECT s_part AS p, min(s_task) AS t FROM {self.staging} WHERE s_query = ? AND s_batch = ? AND s_try = ? GROUP BY s_part"
            chosen = f"s JOIN ({first}) f ON s.s_part = f.p AND s.s_task = f.t WHERE s.s_query = ? AND s.s_batch = ? AND s.s_try = ?"
            own = (self.query, batch_id, attempt)
            execute(c, f"INSERT INTO {self.table} ({names}) SELECT {', '.join('s.' + n for n in self.columns)} FROM {self.staging} {chosen}", *own, *own)
            execute(c, f"DELETE FROM {self.staging} WHERE s_query = ? AND s_batch <= ?", self.query, batch_id)

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        self.prepare(spark)
        if not self.done(spark, batch_id):
            attempt = uuid.uuid4().hex
            self.stage(df, batch_id, attempt)
            self.move(spark, batch_id, attempt)


def once_sink(url: str, table: str, columns: list[str], query: str, **options: str) -> Callable[[DataFrame, int], None]:
    return OnceSink(url, table, columns, query, **options)

"""Sources: topics, JSON tables over topics, change records, the routing table, dimension snapshots.

A topic is a Kafka topic, or for tests and replays a directory of text files with one record a line (kind='files'), each small enough for a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart import schemas
from tidemart.functions import order
from tidemart.operators.cdc import latest_config


def topic_source(spark: SparkSession, topic: str, kind: str = "kafka", streaming: bool = True, starting: str = "latest", **options: str) -> DataFrame:
    """topic, value (string), seq (where the record stands in the topic, see functions/order.py). Options go to Spark's source: kafka.bootstrap.servers and the like, or root, the directory of file topics.

    The position in a Kafka topic is kept in the query's checkpoint; starting ('latest' or 'earliest') counts only for a new query.
    """
    reader = spark.readStream if streaming else spark.read
    if kind == "files":
        path = f"{options.pop('root')}/{topic}"
        # A file is read whole, since nothing but the split tells a line's number.
        lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
        whole = reader.options(**options).text(path, wholetext=True).where(F.octet_length("value") > 0)
        rows = whole.select(F.posexplode(lines).alias("line", "value"), F.col("_metadata"))
        return rows.select(F.lit(topic).alias("topic"), "value", order.in_files(F.col("line")).alias("seq"))
    reader = reader.format("kafka").option("subscribe", topic).options(**options)
    rows = reader.option("startingOffsets", starting if streaming else "earliest").load()
    return rows.select("topic", F.col("value").cast("string").alias("value"), order.in_kafka().alias("seq"))


def json_table(raw: DataFrame, schema: str, rowtime: Column, delay: str | None = "1 second") -> DataFrame:
    """Records of a topic as a table: the fields of schema, and et computed by rowtime with a watermark of delay (none on batches)."""
    rows = raw.select(F.from_json("value", schema).alias("r")).select("r.*").withColumn("et", rowtime)
    return rows.withWatermark("et", delay) if delay and rows.isStreaming else rows


def change_source(raw: DataFrame) -> DataFrame:
    """Envelopes {database, tableName, type, before, after, seq} of a change topic. seq is the envelope's own, else the record's place in the topic."""
    kept = ["seq"] if "seq" in raw.columns else []
    rows = raw.select(F.from_json("value", f"{schemas.CHANGE}, seq {order.SEQ}").alias("r"), *kept).where("r.tableName IS NOT NULL")
    return rows.select("r.database", "r.tableName", "r.type", "r.before", "r.after", F.coalesce("r.seq", *kept).alias("seq"))


def snapshot_source(rows: DataFrame, database: str, table: str, seq: order.Position | Column = order.FIRST) -> DataFrame:
    """A table's rows (say, from spark.read.jdbc) as envelopes of inserts, at the log position seq: by default before all changes.
    sources/handover.py loads tables that change meanwhile."""
    empty = F.create_map().cast("map<string,string>")
    columns = [c for c in rows.columns if c != "seq"]
    after = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))
    place = seq if isinstance(seq, Column) else order.at(seq)
    names = [F.lit(v).alias(c) for c, v in (("database", database), ("tableName", table), ("type", "insert"))]
    return rows.select(*names, empty.alias("before"), after.alias("after"), place.alias("seq"))


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Give partitionColumn, lowerBound, upperBound and numPartitions for tables of size."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def config_source(changes: DataFrame) -> DataFrame:
    """The routing table from its own change history: envelopes with seq."""
    fields = [x.split()[0] for x in schemas.ROUTING.split(", ")]
    return latest_config(changes.select(*[F.try_element_at("after", F.lit(f)).alias(f) for f in fields], "seq"))

"""The streaming jobs: each reads topics, applies the transforms, and returns what a sink takes.

Set spark.sql.streaming.stateStore.providerClass to the RocksDB provider for the jobs with processors. Every query needs a checkpoint location;
Job.start() asks for one. Watermark delays are parameters with the defaults that the jobs' topics need. A job that takes another's rows keeps the
watermark that they have, as a stream has one for each event time column; the delay counts only for rows without any (read from a topic, say).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemart import schemas
from tidemart.functions.scalars import blank, day_text, event_time
from tidemart.operators import cdc, logs, orders, stats
from tidemart.sources.sinks import Batch
from tidemart.streaming import joins, processors

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Job:
    rows: DataFrame
    sink: Batch
    checkpoint: str

    def start(self, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
        """once: takes what is there and ends."""
        writer = self.rows.writeStream.foreachBatch(self.sink).option("checkpointLocation", self.checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def marked(rows: DataFrame, delay: str) -> DataFrame:
    """rows with a watermark on et, unless it has one: a stream's watermark is defined once."""
    return rows if "spark.watermarkDelayMs" in rows.schema["et"].metadata else rows.withWatermark("et", delay)


def parsed(raw: DataFrame) -> DataFrame:
    """Good page or start logs of a topic with mid and et beside their fields."""
    rows = logs.parse_drop_dirty(raw)
    return rows.withColumns({"mid": F.col("common.mid"), "et": event_time(F.col("ts"))}).where("mid IS NOT NULL AND ts IS NOT NULL")


def base_log(raw: DataFrame) -> DataFrame:
    """Raw logs with repaired flags: value is the log's own text; only where a flag was repaired is common.is_new another, and all other fields stay
    as they were. Sinks split it with logs.split_log, logs.displays; dirty records are logs.parse_or_dirty(raw)[1]."""
    rows = parsed(raw).select("mid", "ts", F.col("common.is_new").alias("is_new"), "value")
    out = processors.repaired_is_new(rows)
    return out.select(F.when(F.col("is_new").eqNullSafe(F.col("was")), F.col("value")).otherwise(logs.with_flag(F.col("value"), F.col("is_new"))).alias("value"))


def base_db(raw: DataFrame, config: Callable[[SparkSession], DataFrame], facts: Batch, dims: Batch) -> tuple[DataFrame, Batch]:
    """Change envelopes and the sink that routes them by the routing table as it is when a batch begins."""
    changes = cdc.without_deletes(raw)

    def route(df: DataFrame, batch_id: int) -> None:
        kept = cdc.routed(df, config(df.sparkSession)).persist()
        try:
            facts(cdc.facts(kept), batch_id)
            dims(cdc.dimensions(kept), batch_id)
        finally:
            kept.unpersist()

    return changes, route


def unique_visit(raw: DataFrame, forget: bool = True) -> DataFrame:
    rows = parsed(raw).select("mid", "ts", blank(F.col("page.last_page_id")).alias("entry"), day_text(F.col("et")).alias("day"), "value")
    return processors.unique_visits(rows, forget).select("value")


def user_jump(raw: DataFrame, delay: str = "2 seconds", within_ms: int = 10_000) -> DataFrame:
    rows = parsed(raw).withWatermark("et", delay)
    rows = rows.select("mid", "ts", blank(F.col("page.last_page_id")).alias("entry"), "value", "et")
    return processors.user_jumps(rows, within_ms).select("value")


def order_wide(infos: DataFrame, details: DataFrame, dims: dict[str, DataFrame] | None = None, delay: str = "0 seconds", bound: str = "5 SECONDS") -> DataFrame:
    """Raw order and line topics to wide rows with et. dims, if given, are static: call with_all_dims in the sink for snapshots that follow updates.
    Rows whose create_time doesn't parse have no place in time and can't be joined; orders.without_time(infos) has them for a dirty output."""
    wide = orders.order_wide(marked(orders.order_infos(infos), delay), marked(orders.order_details(details), delay), bound)
    return orders.with_all_dims(wide, dims, F.current_date()) if dims else wide


def order_wide_enriched(infos: DataFrame, details: DataFrame, dims: Callable[[SparkSession], dict[str, DataFrame]], sink: Batch, how: str = "left", **wide: str) -> tuple[DataFrame, Batch]:
    """Wide rows, and the sink that joins them with the six dimensions as they are when a batch begins and gives them to sink; dims reads them anew
    (say, with sinks.dim_snapshot), so a customer's change is seen from the next batch on. An age is as of the batch's day.
    streaming/joins.py as_of has the value of a row's own time instead."""
    rows = order_wide(infos, details, **wide)

    def enrich(df: DataFrame, batch_id: int) -> None:
        sink(orders.with_all_dims(df, dims(df.sparkSession), F.current_date(), how), batch_id)

    return rows, enrich


def base_db_late(raw: DataFrame, config: DataFrame, facts: Batch, dims: Batch, audit: Batch, patience_ms: int = 600_000) -> tuple[DataFrame, Batch]:
    """Like base_db, with the routing table's changes as a stream: a change that comes before its routing row waits for it; audit gets those whose row
    didn't come in patience_ms."""
    rows = joins.routed_late(cdc.without_deletes(raw), config, patience_ms)

    def route(df: DataFrame, batch_id: int) -> None:
        kept = df.persist()
        try:
            found = kept.where(F.col("outcome") == joins.ROUTED).drop("outcome")
            facts(cdc.facts(found), batch_id)
            dims(cdc.dimensions(found), batch_id)
            audit(kept.where(F.col("outcome") == joins.EXPIRED), batch_id)
        finally:
            kept.unpersist()

    return rows, route


def payment_wide(payments: DataFrame, wide: DataFrame, delay: str = "1 second", before: str = "15 MINUTES") -> DataFrame:
    """payments: raw topic; wide: order_wide's rows, or a topic of them read by wide_topic()."""
    return orders.payment_wide(marked(orders.payments(payments), delay), marked(wide, delay), before)


def wide_topic(raw: DataFrame, kind: str = schemas.ORDER_WIDE_ROW) -> DataFrame:
    """A topic of wide rows, written by orders.as_json, with the event time et of their orders (of their payments for PAYMENT_WIDE_ROW)."""
    rows = raw.select(F.from_json("value", kind).alias("r")).select("r.*")
    made = "payment_create_time" if "payment_create_time" in rows.columns else "create_time"
    return rows.withColumn("et", F.try_to_timestamp(made))


def visitor_stats(pages: DataFrame, visits: DataFrame, jumps: DataFrame, delay: str = "13 seconds", size: str = "10 seconds") -> DataFrame:
    """Three raw topics of page logs. A bounce is known 12 seconds after its page at the earliest, hence the delay."""
    facts = stats.visitor_facts(*[logs.parse_drop_dirty(x).drop("value") for x in (pages, visits, jumps)])
    return stats.visitor_stats(marked(facts, delay), size)


def product_stats(facts: list[DataFrame], dims: dict[str, DataFrame], delay: str = "1 second", size: str = "10 seconds") -> DataFrame:
    """Facts of any kinds (stats.order_facts and the like), each with a watermark of its own or none so far."""
    return stats.product_stats(stats.product_facts(*[marked(f, delay) for f in facts]), dims, size)


def province_stats(wide: DataFrame, delay: str = "1 second", size: str = "10 seconds") -> DataFrame:
    return stats.province_stats(marked(wide, delay), size=size)


def keyword_stats(raw: DataFrame, delay: str = "1 second", size: str = "10 seconds") -> DataFrame:
    words = stats.split_keywords(stats.searched(logs.parse_drop_dirty(raw)))
    return stats.keyword_stats(words.withWatermark("et", delay), size)

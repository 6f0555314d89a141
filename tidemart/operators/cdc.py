"""Change records: normalising, whitelisting columns, routing by configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.functions import order


def normalized(changes: DataFrame) -> DataFrame:
    """changes (topic 'server.database.table', value: a change record with before, after, op, and its source) as database, tableName, type, before,
    after, seq. seq is the place in the log that the record's source names, else seq of changes (its place in the topic), else null.

    Missing images become empty maps. Operations: c, create and r (snapshot read) are 'insert', u 'update', d 'delete', others stay in lower case.
    """
    r = F.from_json("value", f"before map<string,string>, after map<string,string>, op string, source {order.SOURCE}")
    kept = ["seq"] if "seq" in changes.columns else []
    op = F.lower(F.col("r.op"))
    kind = F.when(op.isin("c", "create", "r", "read"), "insert").when(op == "u", "update").when(op == "d", "delete").otherwise(op)
    part = F.split("topic", r"\.")
    empty = F.create_map().cast("map<string,string>")
    return changes.select("topic", r.alias("r"), *kept).select(
        F.get(part, F.lit(1)).alias("database"),
        F.get(part, F.lit(2)).alias("tableName"),
        kind.alias("type"),
        F.coalesce("r.before", empty).alias("before"),
        F.coalesce("r.after", empty).alias("after"),
        F.coalesce(order.in_log(F.col("r.source")), *kept).alias("seq"),
    )


def without_deletes(changes: DataFrame) -> DataFrame:
    """All but deletes; a null type stays."""
    return changes.where(~F.col("type").eqNullSafe("delete"))


def whitelisted(after: Column, columns: Column) -> Column:
    """The entries of after whose keys the comma-separated columns list, exactly."""
    allowed = F.split(columns, ",")
    return F.map_filter(after, lambda k, _: F.array_contains(allowed, k))


def latest_config(config_changes: DataFrame) -> DataFrame:
    """The last row of each (source_table, operate_type) of a routing table's change history (with seq; of equal seqs the greatest row); rows
    without keys (deletes) are ignored."""
    keyed = config_changes.where(F.col("source_table").isNotNull() & F.col("operate_type").isNotNull())
    whole = F.struct(*[c for c in config_changes.columns if c != "seq"])
    return keyed.groupBy("source_table", "operate_type").agg(F.max_by(whole, F.struct("seq", whole)).alias("r")).select("r.*")


def routed(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes that the routing table knows by (tableName, type), with sink_table, sink_type, sink_pk and after cut to its sink_columns.
    The routing table is written by hand and has one row per table and operation, so it is broadcast while Spark's own threshold allows."""
    c = config.select("source_table", "operate_type", "sink_type", "sink_table", "sink_columns", F.coalesce("sink_pk", F.lit("id")).alias("sink_pk"))
    met = changes.join(c, (F.col("tableName") == F.col("source_table")) & (F.col("type") == F.col("operate_type")))
    return met.withColumn("after", whitelisted(F.col("after"), F.col("sink_columns"))).drop("source_table", "operate_type", "sink_columns")


def unrouted(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes that no row of the routing table matches, for audit."""
    return changes.join(config, (F.col("tableName") == F.col("source_table")) & (F.col("type") == F.col("operate_type")), "left_anti")


def facts(routed_: DataFrame) -> DataFrame:
    return routed_.where("sink_type = 'kafka'")


def dimensions(routed_: DataFrame) -> DataFrame:
    """Changes for dimension tables; the sink type keeps its historical name in the routing table."""
    return routed_.where("sink_type = 'hbase'")

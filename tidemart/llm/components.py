"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.llm import scratch


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: a, b (bigint). node, component (and was): each node of a link and the smallest node that it is connected with.

    Each round takes the least label among a node's neighbours and then the label's own label, so chains halve; both are
    aggregates and joins of one row per key, and each round's labels are written. No links give no rows.
    """
    with scratch.scope(links.sparkSession) as own:
        return own.keep(_components(links, max_rounds))


def _components(links: DataFrame, max_rounds: int) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.written(both, "links")
    labels = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        hooked = labels.select("node", "component").join(near, F.col("node") == F.col("a")).select("node", F.least("component", "m").alias("c"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("upper"))
        jumped = hooked.join(up, F.col("c") == F.col("up"), "left").select("node", F.least("c", "upper").alias("component"), "was")
        step = scratch.written(jumped, "labels")
        if not step.where(F.col("component") != F.col("was")).head(1):
            return step
        scratch.drop(labels)
        labels = step
    raise RuntimeError("components did not settle")

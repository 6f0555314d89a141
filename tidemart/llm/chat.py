"""Chat formatting: cumulative-snapshot collapse, with DataFrame functions only.

A chat that is logged again after every turn leaves many rows that are prefixes of the last log. Turns are put in
order and each gets the running xor of the hashes of (position, role, text) up to it: two 64-bit sums that name the
prefix ending there. A conversation is covered if its whole length is a prefix of a longer one, or the whole of one
with a smaller id. Prefixes are aggregated by name (no pairs are made), covered conversations leave by an anti-join,
and the turns of the rest are rendered with their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemart.llm.tables import table


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template: <|role|>, newline, text, <|end|>, newline. Null role or text: empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def maximal_conversations(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """turns: conv_id, turn, role, text (others are ignored). One row per turn of each conversation that is kept:
    conv_id, position (from 0, by turn, then role and text), role, segment, start (characters rendered before it),
    length, is_target.

    Nulls: a null conv_id is one conversation of its own; null turns come first; null and empty roles or texts are
    different turns but render alike. Repeated rows are turns of their own. Of equal conversations the smallest id
    stays (a null id yields to others). An empty table gives no rows.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    t = turns.select("conv_id", "turn", "role", "text").withColumn("position", (F.row_number().over(w) - 1).cast("long"))
    part = [F.col("position"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    t = t.withColumn("segment", rendered(F.col("role"), F.col("text"))).select(
        "*",
        *[F.bit_xor(F.xxhash64(F.lit(seed), *part)).over(so_far).alias(f"prefix{seed}") for seed in (1, 2)],
        F.sum(F.length("segment").cast("long")).over(so_far).alias("until"),
        F.count(F.lit(1)).over(whole).alias("n"),
    )
    name = ["position", "prefix1", "prefix2"]
    last = F.col("n") == F.col("position") + 1
    known = t.groupBy(*name).agg(F.max("n").alias("longest"), F.min(F.when(last, F.col("conv_id"))).alias("first_whole"))
    covered = (
        t.where(last)
        .join(known, name)
        .where((F.col("longest") > F.col("n")) | ~F.col("conv_id").eqNullSafe(F.col("first_whole")))
        .select(F.col("conv_id").alias("covered_id"))
    )
    kept = t.join(covered, F.col("conv_id").eqNullSafe(F.col("covered_id")), "left_anti")
    length = F.length("segment").cast("long")
    return kept.select(
        "conv_id", "position", "role", "segment", (F.col("until") - length).alias("start"), length.alias("length"),
        F.coalesce(F.col("role") == target_role, F.lit(False)).alias("is_target"),
    )


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered turns of all maximal conversations."""
    return maximal_conversations(table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS segment
  FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY position) AS turns FROM t GROUP BY conv_id),
p AS (
  SELECT conv_id, n, k, turns[1:k] AS prefix FROM (SELECT c.*, unnest(range(1, n + 1)) AS k FROM c)),
covered AS (
  SELECT DISTINCT a.conv_id FROM c a JOIN p b ON a.n = b.k AND a.turns = b.prefix
  WHERE b.n > a.n OR b.conv_id < a.conv_id)
SELECT conv_id, position::BIGINT AS position, role, segment,
       (coalesce(sum(length(segment)) OVER (PARTITION BY conv_id ORDER BY position
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
       length(segment)::BIGINT AS length, coalesce(role = 'assistant', false) AS is_target
FROM t WHERE conv_id NOT IN (SELECT conv_id FROM covered)
"""

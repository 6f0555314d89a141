"""Mixing sources to target weights: pivotal dependent rounding.

Each source gets a target of words by its weight, at most a multiple of what it has; what a source can't take is shared among
the others. Each of a source's documents then has the same expected number of copies, target over size: a whole part and a
fraction. The fractions are rounded in pairs: words of fractional copies move from one document of a pair to the other, which
way at random with the odds that keep each document's expectation, until one of the two has all of its words or none. The one
left fractional goes on to the next pair. So no pair changes the source's sum of words.

Pairs are made in buckets of documents dealt by a hash; what a bucket leaves over (one document) meets the rest of other
buckets in the next round, a reduction tree with ``BRANCH`` children a node. The last one left of a source is cut: it is taken
with its leading words, as many as are missing (cut=False rounds it to a whole copy or none, at random).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import scratch
from tidemart.llm.tables import table

#: Weights of the sources in code point order, repeating; words of the mix over all words; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents of a bucket, and rests that meet in a node of the tree.
BRANCH = 256
#: Equal rows that one task writes out at once.
BLOCK = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """source, doc_id, size (words of the text, null: 0), n: rows equal in all three are one with their number."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long")
    return docs.select(F.col("source").cast("string").alias("source"), "doc_id", size.alias("size")).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with place: 0, 1, ... by source in code point order, null last. Ranges are numbered side by side; only their sizes meet on the driver."""
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = scratch.written(sources.repartitionByRange(ranges, order).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    begin, starts = 0, []
    for part in sorted(counts):
        starts.append((part, begin))
        begin += counts[part]
    starts = spark.createDataFrame(starts, "part int, begin long")
    within = F.expr("row_number() OVER (PARTITION BY part ORDER BY source ASC NULLS LAST) - 1")
    return parts.withColumn("at", within).join(F.broadcast(starts), "part").withColumn("place", F.col("begin") + F.col("at")).drop("part", "at", "begin")


def targets(sources: DataFrame, weights: Iterable[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (place, source_size) with target. A level rises until the sources' shares (weight times level, or most times their size if that is less)
    come to the budget; each round is one aggregate and leaves two numbers on the driver. At most as many rounds as sources."""
    weights = list(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = scratch.written(sources.withColumns({"weight": weight, "cap": F.col("source_size").cast("double") * most}), "targets")
    total, all_weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * float(total or 0)
    level = budget / all_weights if all_weights else 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        taken, left = rows.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (budget - (taken or 0.0)) / left if left else level
        if higher <= level:
            break
        level = higher
    return rows.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level))).drop("weight", "cap")


def rounded(size: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """mass (words of a fractional copy, between 0 and size) after pairwise rounding: all but one are 0 or their size, the sum is as before.
    Returns the masses and the place of the one left fractional, -1 if none is."""
    mass = mass.astype(np.float64)
    left = np.flatnonzero((mass > 0) & (mass < size))
    while len(left) > 1:
        half = len(left) // 2
        a, b, rest = left[:half], left[half : 2 * half], left[2 * half :]
        up, down = np.minimum(size[a] - mass[a], mass[b]), np.minimum(mass[a], size[b] - mass[b])
        raise_a = rng.random(half) * (up + down) < down
        moved = np.where(raise_a, up, -down)
        # What reaches a bound is set to it: a difference may miss it by the last bit.
        a_ends = np.where(raise_a, up >= size[a] - mass[a], down >= mass[a])
        b_ends = np.where(raise_a, up >= mass[b], down >= size[b] - mass[b])
        mass[a], mass[b] = (
            np.where(a_ends, np.where(raise_a, size[a], 0), mass[a] + moved),
            np.where(b_ends, np.where(raise_a, 0, size[b]), mass[b] - moved),
        )
        left = np.concatenate([a[~a_ends], b[~b_ends], rest])
    return mass, int(left[0]) if len(left) else -1


def _level(items: DataFrame, level: int, seed: int) -> DataFrame:
    """Each bucket's items rounded; open marks the one left over."""

    def round_(key: tuple, items: pa.Table) -> pa.Table:
        items = items.sort_by([("h", "ascending"), ("size", "ascending"), ("doc_id", "ascending")])
        rng = np.random.default_rng([seed, level, key[0].as_py(), key[1].as_py()])
        mass, last = rounded(items["size"].to_numpy(), items["mass"].to_numpy(), rng)
        is_open = np.arange(len(mass)) == last
        return items.set_column(items.schema.get_field_index("mass"), "mass", pa.array(mass)).set_column(items.schema.get_field_index("open"), "open", pa.array(is_open))

    return items.groupBy("place", "bucket").applyInArrow(round_, items.schema)


def _repeated(rows: DataFrame, n: str) -> DataFrame:
    """Each row as often as its n says; large numbers are dealt out in blocks, so that no task writes them all."""
    again = lambda df: df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop("_i", n)
    few, many = rows.where(F.col(n) <= BLOCK), rows.where(F.col(n) > BLOCK)
    size = F.when(F.col("_b") < F.floor((F.col(n) - 1) / BLOCK), F.lit(BLOCK)).otherwise((F.col(n) - 1) % BLOCK + 1)
    blocks = many.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / BLOCK).cast("int")))).withColumn(n, size)
    return again(few).union(again(blocks.repartition("doc_id", "_b").drop("_b")))


def mixed(docs: DataFrame, weights: Iterable[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 11, cut: bool = True) -> DataFrame:
    """docs: doc_id, text, source (others are ignored). One row per row of docs: doc_id, source, size, source_size, target, taken (words).

    Null texts have no words; a null source is a source of its own, the last. Rows equal in id, source and size get their copies as if rounded
    among themselves first, and differ by one copy at most (but for the source's cut document). Null ids are ids like others. Sources without
    words have target 0. Chance comes from a hash of id and size and from seed, so results don't depend on how rows are dealt. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    with scratch.scope(spark) as own:
        rows = scratch.written(sized(docs), "sizes")
        by_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("rows"))
        by_source = own.keep(scratch.written(targets(ranked(by_source), weights, share, most), "sources"))
        known = scratch.small(by_source.withColumnRenamed("source", "_source"))
        met = rows.join(known, F.col("source").eqNullSafe(F.col("_source")))
        # Copies that a row of the source expects; n equal rows expect n times as many: some have one more, one has a fraction.
        copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        whole = F.floor(copies).cast("long")
        more = F.floor(F.col("n") * (copies - whole)).cast("long")
        mass = (F.col("n") * (copies - whole) - more) * F.col("size")
        buckets = F.ceil(F.col("rows") / BRANCH).cast("long")
        items = met.select(
            "place", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), buckets).alias("bucket"), F.xxhash64(F.lit(seed + 1), "doc_id", "size").alias("h"), "doc_id", "size", "n",
            whole.alias("whole"), more.alias("more"), mass.alias("mass"), F.lit(False).alias("open"),
        )
        left = -(-(by_source.agg(F.max("rows")).first()[0] or 0) // BRANCH)  # buckets of the largest source
        done, level = [own.keep(scratch.written(_level(items, 0, seed), "round"))], 0
        while left > 1:
            level, left = level + 1, -(-left // BRANCH)
            waiting = done[-1].where("open").withColumn("bucket", F.floor(F.col("bucket") / BRANCH)).withColumn("open", F.lit(False))
            done.append(own.keep(scratch.written(_level(waiting, level, seed), "round")))
    settled = done[-1]
    for d in done[:-1]:
        settled = settled.union(d.where("NOT open"))
    last = F.col("mass")
    if cut:
        extra = F.round(last).cast("long")
    else:
        draw = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", "size"), F.lit(1 << 30)) / float(1 << 30)
        extra = F.when(~F.col("open"), last.cast("long")).otherwise(F.when(draw * F.col("size") < last, F.col("size")).otherwise(0))
    base, full = F.col("whole") * F.col("size"), (F.col("whole") + 1) * F.col("size")
    kinds = F.array(*[F.struct(t.alias("taken"), c.cast("long").alias("times")) for t, c in ((base + extra, F.lit(1)), (full, F.col("more")), (base, F.col("n") - F.col("more") - 1))])
    each = settled.select("place", "doc_id", "size", F.explode(kinds).alias("k")).select("place", "doc_id", "size", "k.taken", "k.times").where("times > 0")
    out = _repeated(each, "times").join(scratch.small(by_source), "place")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))

"""Filter interaction audit: what each filter removes in every order of the filters, with DataFrame functions only.

Texts are read once, into narrow rows: a digest of the text, its part, and a mask with a bit for each filter that the document
fails. Documents with equal masks, labels and part are one cell, so what follows doesn't grow with the documents. Each cell's
mask is folded along each order of the order array (120 for five filters) by ``aggregate`` inside ``transform``: 600 structs
of counts, weighted with the cell's number of documents. The cells' structs are merged element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import scratch
from tidemart.llm.tables import table

#: Filter letters in the order of their bits; the last compares documents with each other, the others look at one text.
FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Labelled documents that are broadcast at most, about 150 bytes each in memory; more are shuffled.
FEW = 1 << 19
_GAP = r"[\x20\x09-\x0D]+"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Which of A to D a text (not null) fails; words are its words."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)) * 100 < n * 80,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, mask of A to D, n: equal rows are one with their number."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", _GAP), ""))
    fails = text_failures(F.col("text"), F.col("words"))
    mask = sum((F.when(c, BIT[f]).otherwise(0) for f, c in fails.items()), F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    return rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def with_copies(rows: DataFrame) -> DataFrame:
    """rows of masks() with E's bit for texts that a smaller doc_id has too. The least id of each text is an aggregate; it comes back by the pair
    of text and id, so a text with very many copies is no hot key."""
    least = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_least", F.lit(True))
    met = rows.join(least, ["digest", "doc_id"], "left")
    again = F.col("doc_id").isNotNull() & F.col("is_least").isNull()
    return met.select("doc_id", "part", "digest", F.when(again, F.col("mask") + BIT["E"]).otherwise(F.col("mask")).alias("mask"), "n")


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: the documents of each combination. Rows without an id have no labels; they are dealt by their text."""
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(f"is_{c}") for c in ("quality", "toxic")])
    flags = scratch.written(flags.where("is_quality OR is_toxic").withColumn("deal", F.lit(0)), "flags")
    dealt = rows.withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    met = dealt.join(scratch.small(flags, FEW), ["doc_id", "deal"], "left")
    keys = ["part", "mask", *[F.coalesce(f"is_{c}", F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]]
    return met.groupBy(*keys).agg(F.sum("n").alias("n"))


def folded(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """array (one per order) of arrays (one per step) of structs of COUNTS for a cell of n documents."""
    kind = "array<struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>"
    weight = lambda c: F.when(c, n).otherwise(F.lit(0)).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails, gone = mask.bitwiseAND(bit) != 0, state["gone"]
        here = fails & ~gone
        counts = (~(gone | fails), here, fails & gone, mask == bit, here & good, here & toxic)
        row = F.struct(*[weight(c).alias(name) for name, c in zip(COUNTS, counts, strict=True)])
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(row)).alias("steps"))

    orders = F.array(*[F.array(*[F.lit(BIT[f]) for f in order]) for order in ORDERS])
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(kind).alias("steps"))
    return F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["steps"]))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang; labels: doc_id, quality, toxic (others are ignored). One row per part (language, null: empty), order of the
    filters and step, zeros included: part, filter_order, step, COUNTS and shapley, all bigints.

    Null and empty texts are the same empty text. A null doc_id is no smaller than any and has none smaller; equal ids with equal texts don't
    remove each other. Repeated rows are documents of their own. A document with several labels is good (toxic) if one says so. An empty
    table gives no rows.
    """
    with scratch.scope(docs.sparkSession) as own:
        rows = scratch.written(masks(docs), "masks")
        found = own.keep(scratch.written(cells(with_copies(rows), labels), "cells"))  # at most 128 rows a part
    steps = found.select("part", F.posexplode(folded(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"))).alias("place", "steps"))
    steps = steps.select("part", "place", F.posexplode("steps").alias("at", "s")).select("part", "place", "at", "s.*")
    merged = steps.groupBy("part", "place", "at").agg(*[F.sum(c).alias(c) for c in COUNTS])
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("place") + 1)
    named = merged.select("part", order.alias("filter_order"), (F.col("at") + 1).alias("step"), *COUNTS)
    named = named.withColumn("letter", F.expr("substr(filter_order, step, 1)"))
    shares = named.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return named.join(shares, ["part", "letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_BITS = " + ".join(f"CASE WHEN contains({{0}}, '{f}') THEN {b} ELSE 0 END" for f, b in BIT.items())
OP12_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM m LEFT JOIN g USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
p AS (SELECT l1.f || l2.f || l3.f || l4.f || l5.f AS filter_order FROM l l1, l l2, l l3, l l4, l l5
  WHERE len(list_distinct([l1.f, l2.f, l3.f, l4.f, l5.f])) = 5),
o AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS past FROM p, unnest(range(1, 6)) AS r(step)),
s AS (SELECT filter_order, step, letter, {_BITS.format('letter')} AS bit, {_BITS.format('past')} AS before FROM o),
x AS (SELECT part, filter_order, step, letter,
    CAST(sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM x"""

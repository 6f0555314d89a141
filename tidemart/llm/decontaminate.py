"""Benchmark decontamination: prefix-filtered set join, with DataFrame functions only.

Words are ASCII letters (A-Z lower-cased), digits and everything beyond ASCII. A window is ``width`` consecutive words
of a benchmark item, or the whole item if that is shorter. A text that contains a window contains all its words, so it
contains the window's rarest word (ties: the first by text, then by place): that one token is the necessary prefix of the
set join. Rarity is the count of a word over all documents. The steps are

1. count the benchmark's words over all documents;
2. pick the rarest word of each window as its probe, at a known offset;
3. join the documents' words with the probes: each hit fixes where in the document the window would have to begin, and the
   positional bound drops those that would stick out at either end;
4. verify the whole window, word by word, at that place, and mark its words.

The number of candidates is that of occurrences of probe words, not of pairs of documents or windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm.columns import let, positions
from tidemart.llm.tables import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Benchmark side of a join is broadcast up to so many bytes of benchmark text; beyond it Spark shuffles.
BROADCAST_BYTES = 16_000_000


def words(text: Column) -> Column:
    """The words as they stand; no letter is folded."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def rough(word: Column) -> Column:
    """A key that equal words share whatever the case of their letters; it may also join others, which step 4 sorts out. Of a single
    word on both sides: the lower case of a capital sigma depends on what surrounds it, also across a gap."""
    return F.lower(word)


def _windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, w (array<string>): the distinct windows of each item."""
    split = items.select("item_id", words(folded(F.coalesce("text", F.lit("")))).alias("all")).where(F.size("all") > 0)
    starts = positions(F.greatest(F.size("all") - (width - 1), F.lit(1)))
    return split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("all"), i + 1, width))).alias("w")).distinct()


def row_key() -> Column:
    """Names a row of documents by its id and text."""
    return F.xxhash64("doc_id", "text")


def hits(docs: DataFrame, items: DataFrame, width: int = 13, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. For each row of docs: doc_id, n_words, n_hit, n_items, items (sorted
    array<string> of the item ids with a window in the text), key (row_key() of the row).

    Null texts have no words and no hits; items without words match nothing; a null item_id is listed as the string
    'null'. Rows with the same doc_id (or none) are documents of their own. Other columns are ignored.
    """
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    small = F.broadcast if size * width <= broadcast_bytes else (lambda df: df)  # all windows together
    d = docs.select(row_key().alias("key"), "doc_id", "text")
    windows = _windows(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text"), width)
    windows = windows.withColumn("wid", F.xxhash64("item_id", F.array_join("w", " ")))

    exploded = d.select("key", F.posexplode(F.transform(words(F.col("text")), rough)).alias("at", "word"))
    bench = windows.select(F.explode(F.transform("w", rough)).alias("word")).distinct()
    counts = exploded.select("word").join(small(bench), "word").groupBy("word").agg(F.count(F.lit(1)).alias("c"))

    spread = windows.select("wid", "item_id", "w", F.posexplode(F.transform("w", rough)).alias("offset", "word"))
    spread = spread.join(small(counts), "word", "left").na.fill(0, ["c"])
    probes = spread.groupBy("wid").agg(
        F.min(F.struct("c", "word", "offset")).alias("p"), F.first("item_id").alias("item_id"), F.first("w").alias("w")
    )
    probes = probes.where(F.col("p.c") > 0).select(F.col("p.word").alias("word"), F.col("p.offset").alias("offset"), "item_id", "w")
    by_word = probes.groupBy("word").agg(F.collect_list(F.struct("offset", "item_id", "w")).alias("probes"))

    # Candidates: where a probe word stands in which document. One row per document that has any.
    met = exploded.join(small(by_word.select("word")), "word").groupBy("key").agg(F.collect_list(F.struct("at", "word")).alias("met"))
    begin = lambda m: F.greatest(m["at"] - (width - 1), F.lit(0))
    around = lambda every, m: F.transform(F.slice(every, begin(m) + 1, 2 * width - 1), folded)
    parts = let(
        words(F.col("text")),
        lambda every: F.transform("met", lambda m: F.struct(m["word"].alias("word"), m["at"].alias("at"), begin(m).alias("from"), around(every, m).alias("part"))),
    )
    near = d.join(met, "key").select("key", F.explode(parts).alias("m")).select("key", "m.*")
    fits = lambda p: (F.col("at") >= p["offset"]) & (
        F.slice(F.col("part"), F.greatest(F.col("at") - p["offset"] - F.col("from"), F.lit(0)) + 1, F.size(p["w"])) == p["w"]
    )
    found = near.join(small(by_word), "word").select("key", "at", F.filter("probes", fits).alias("ok")).where(F.size("ok") > 0)
    spans = found.select(
        "key",
        F.explode(F.transform("ok", lambda p: F.struct((F.col("at") - p["offset"]).alias("s"), F.size(p["w"]).alias("l"), p["item_id"].alias("i")))).alias("x"),
    )
    marked = spans.groupBy("key").agg(
        F.collect_set(F.struct(F.col("x.s").alias("s"), (F.col("x.s") + F.col("x.l")).alias("e"))).alias("spans"), F.collect_set("x.i").alias("items")
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        F.sort_array("spans"),
        start,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end")
        ),
    )["n"]
    marked = marked.select("key", covered.cast("long").alias("n_hit"), F.sort_array("items").alias("items"))
    counted = d.select("key", "doc_id", F.coalesce(F.size(words(F.col("text"))), F.lit(0)).cast("long").alias("n_words"))
    return counted.join(marked, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "key",
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, w[s:s + 12] AS g, least(len(w), 13) AS l
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, l, w[s:s + l - 1] AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
h AS (SELECT doc_id, s, dw.l, item_id FROM dw JOIN iw USING (l, g)),
p AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM (SELECT doc_id, s, unnest(range(0, l)) AS o FROM h) GROUP BY doc_id),
n AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
"""

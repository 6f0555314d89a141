"""LM scoring: a gated recurrent language model over whole documents.

Words are counted over all training documents, which fixes the model's classes, the baseline, and how the words of a class
that are too rare for weights of their own share its probability. The recurrent part is trained in rounds: each task trains on
its own documents from the same weights, and the weights are averaged by the number of words. Counts of rare words, whose
number grows with the corpus, are never gathered in one place: documents' rare words are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import gru, scratch
from tidemart.llm.arrow_text import WordHasher, blocks, utf8
from tidemart.llm.tables import table

#: Counts that each task holds: those of the most frequent words. All others are joined.
FREQUENT = 1 << 18
#: Share of the training documents, by a hash of the id, on which the recurrent weights are fitted; in how many rounds.
TRAIN_SHARE, ROUNDS = 1.0, 2
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 1 << 21
_fold = np.arange(256, dtype=np.uint8)
_fold[ord("A") : ord("Z") + 1] += 32
END_HASH = np.uint64(0x656E64)


def forms(data: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """The form class of words [first, last) of data: by their last two bytes and whether a byte is beyond ASCII."""
    if not len(first):
        return np.zeros(0, np.int64)
    a, b = _fold[data[last - 1]].astype(np.int64), np.where(last - first > 1, _fold[data[np.maximum(last - 2, 0)]], 0)
    beyond = np.maximum.reduceat(data[: last[-1]], first) >= 128
    return (a * 31 + b * 7) % (n // 2) + beyond * (n // 2)


def tokenised(texts: pa.Array, hasher: WordHasher, n_forms: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row bounds in words, hashes, form classes) of blocks of rows."""
    data, offsets = utf8(texts)
    for i, j in blocks(offsets):
        h, s, e, row = hasher.words(data, offsets[i : j + 1])
        yield i, np.searchsorted(row, np.arange(i, j + 1) - i), h, forms(data, s, e, n_forms)


def word_counts(docs: DataFrame, n_forms: int) -> DataFrame:
    """word (hash), form, c: of every word of docs (text) and of the end of a text (form -1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, ends = WordHasher(), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, f, c = (np.concatenate([x[k] for x in held]) for k in range(3))
            u, at, inv = np.unique(h, return_index=True, return_inverse=True)
            return u, f[at], np.bincount(inv, c, len(u)).astype(np.int64)

        def batch(h, f, c) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f, pa.int64()), pa.array(c)], names=["word", "form", "c"])

        for b in batches:
            ends += b.num_rows
            for _, _, h, f in tokenised(b.column(0), hasher, n_forms):
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, f[at], n))
                if sum(len(x[0]) for x in held) > HELD_WORDS:
                    held = [summed()]
                    if len(held[0][0]) > HELD_WORDS // 2:
                        yield batch(*held.pop())
        if held:
            yield batch(*summed())
        if ends:
            yield batch(np.array([END_HASH]), np.array([-1]), np.array([ends]))

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word long, form long, c long")
    return rows.groupBy("word").agg(F.min("form").alias("form"), F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The words of counts (word, form, c) with the highest counts, most of them, or all if there are fewer. A table of how many words have about
    which count (16 steps from a count to twice it) tells where to begin, so nothing is sorted; of the step that doesn't fit whole those
    words are taken whose hash is below a bound that a second table of 4096 parts tells: at most a part too few."""
    step = F.floor(F.log2("c") * 16)
    begin, room, at = None, most, None
    for at, n in sorted(map(tuple, counts.groupBy(step.alias("step")).count().collect()), reverse=True):  # about a thousand rows, whatever the input
        if n > room:
            break
        begin, room = at, room - n
    else:
        return counts
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 12))
    bound = 0
    for p, n in sorted(map(tuple, counts.where(step == at).groupBy(part.alias("part")).count().collect())):
        if n > room:
            break
        bound, room = p + 1, room - n
    taken = (step == at) & (part < bound)
    return counts.where(taken if begin is None else taken | (step >= begin))


class Vocabulary:
    """The frequent words: hashes (sorted), their counts, and the symbols of those that the model knows."""

    def __init__(self, shape: gru.Shape, words: np.ndarray, counts: np.ndarray) -> None:
        """words, counts: in falling order of counts, without the end."""
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.symbols = np.where(order < shape.heads, order, -1)

    def look_up(self, h: np.ndarray, form: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, count or 0, whether the word is here) of each hash."""
        if not len(self.words):
            return heads + form, np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        once, back = np.unique(h, return_inverse=True)  # a block has few different words, and looking up costs more than sorting
        at = np.minimum(np.searchsorted(self.words, once), len(self.words) - 1)
        here = self.words[at] == once
        symbol, count = np.where(here, self.symbols[at], -1)[back], np.where(here, self.counts[at], 0)[back]
        return np.where(symbol >= 0, symbol, heads + form), count, here[back]


def part(docs: DataFrame, round_: int, rounds: int, share: float) -> DataFrame:
    """The rows of docs (doc_id, text) that a round learns from: the rounds split the share, so that all of them see each of its rows once."""
    mark = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30))
    lo, hi = (int(share * (1 << 30) * (round_ + k) / rounds) for k in (0, 1))
    return docs.where((mark >= lo) & (mark < hi))


def trained(docs: DataFrame, shape: gru.Shape, vocabulary, flat: np.ndarray, round_: int, rounds: int, share: float) -> np.ndarray:
    """flat after one round: the mean over tasks, weighted by their words, of what each makes of it on its part of docs (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    start = sc.broadcast(flat)
    schema = "chunk long, weight double, w array<double>"

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, voc = WordHasher(), vocabulary.value

        def texts():
            for b in batches:
                found = []
                for _, bounds, h, f in tokenised(b.column(0), hasher, shape.forms):
                    s = voc.look_up(h, f, shape.heads)[0]
                    found += [s[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield found

        new, seen = gru.train(shape, start.value, texts())
        if seen:
            w = new.astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(0, len(w), 4096), pa.int64()), pa.array([float(seen)] * len(range(0, len(w), 4096))), pa.array([w[k : k + 4096] for k in range(0, len(w), 4096)], pa.list_(pa.float64()))],
                names=["chunk", "weight", "w"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, weight, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                old = sums.setdefault(k, [0.0, 0.0])
                old[0] += weight
                old[1] = old[1] + w.values.to_numpy()
        for k, (weight, w) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([weight]), pa.array([w], pa.list_(pa.float64()))], names=["chunk", "weight", "w"])

    parts = part(docs, round_, rounds, share).select(F.col("text").cast("string").alias("text")).mapInArrow(fit, schema)
    out = flat.copy()
    # Tasks' weights come together chunk by chunk, and first those of some tasks each: no reducer gets a part of every task's at once.
    some = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))).repartition("chunk", "part").drop("part")
    for r in some.mapInArrow(add, schema).repartition("chunk").mapInArrow(add, schema).toLocalIterator():  # one model, whatever the input
        out[r[0] : r[0] + len(r[2])] = np.array(r[2]) / r[1]
    return out


def scored(docs: DataFrame, held_out: Column, shape: gru.Shape | None = None, share: float = TRAIN_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities); learns from
    rows where held_out is false (or null).

    Null, empty and white-space texts are just the end of a text. Repeated rows count and are scored like any others; other columns
    are ignored. If nothing is left to learn from, only the prior is left of both models; an empty table gives no rows.
    """
    shape = shape or gru.Shape()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learn = docs.where(~F.col("held_out"))
    counts = scratch.written(word_counts(learn, shape.forms), "counts")
    top = frequent(counts.where("form >= 0")).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)  # bounded
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    ends = counts.where("form = -1").agg(F.coalesce(F.sum("c"), F.lit(0))).head()[0]
    words, c = top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    # Words of a form class that have no weights of their own: how often, how many.
    rest = np.zeros((shape.forms, 2))
    for form, total, kinds in counts.where("form >= 0").groupBy("form").agg(F.sum("c"), F.count(F.lit(1))).collect():  # one row per form class
        rest[form] = total, kinds
    heads = top.iloc[: shape.heads]
    np.subtract.at(rest, heads["form"].to_numpy(np.int64), np.stack([heads["c"], np.ones(len(heads))], 1))
    symbols = np.zeros(shape.symbols)
    symbols[: len(heads)] = heads["c"]
    symbols[shape.heads : -1], symbols[-1] = rest[:, 0], ends
    vocabulary = spark.sparkContext.broadcast(Vocabulary(shape, words, c))  # FREQUENT entries of 24 bytes
    flat = gru.initial(shape, symbols)
    for r in range(rounds):
        flat = trained(learn, shape, vocabulary, flat, r, rounds, share)
    weights = spark.sparkContext.broadcast(flat)
    form_norm = np.log10(rest.sum(1) + 1)
    log_end = float(np.log10(ends + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, voc, w = WordHasher(), vocabulary.value, weights.value
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            m = b.num_rows
            n_words, known, log_c, prior = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
            texts, rare = [], []
            for i, bounds, h, f in tokenised(b.column(1), hasher, shape.forms):
                symbol, count, here = voc.look_up(h, f, shape.heads)
                row = np.repeat(np.arange(i, i + len(bounds) - 1), np.diff(bounds))
                logs, form = np.log10(count + 1), symbol - shape.heads
                n_words += np.bincount(row, minlength=m)
                known += np.bincount(row[here], minlength=m)
                log_c += np.bincount(row, logs, m)
                prior += np.bincount(row, np.where(form >= 0, logs - form_norm[np.maximum(form, 0)], 0), m)
                texts += [symbol[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                away = np.where(here, np.uint64(0), h)
                for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                    part = away[x:y]
                    rare.append(part[part > 0].view(np.int64))
            model = gru.log_probabilities(shape, w, texts) / np.log(10)
            key = at + np.arange(m, dtype=np.int64)
            at += m
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), b.column(0), b.column(2), pa.array(n_words + 1), pa.array(known + (ends > 0)), pa.array(log_c + log_end), pa.array(model + prior), pa.array(rare, pa.list_(pa.int64()))],
                names=["key", "doc_id", "held_out", "n_tokens", "n_known", "log_c", "model", "rare"],
            )

    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, log_c double, model double, rare array<bigint>"
    first = scratch.written(docs.select("doc_id", "text", "held_out").mapInArrow(score, schema), "scores")
    spread = first.select("key", F.explode("rare").alias("word")).groupBy("word", "key").agg(F.count(F.lit(1)).alias("tf"))
    more = (
        spread.join(counts.select("word", "c"), "word")
        .groupBy("key")
        .agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more_log"))
    )
    out = first.drop("rare").join(more, "key", "left").na.fill(0, ["more", "more_log"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("log_c") + F.col("more_log") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("model") + F.col("more_log")).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those whose crc32(doc_id as text) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)

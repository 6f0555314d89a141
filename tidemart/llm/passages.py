"""Passages that stand in several documents: the words of a text that are part of a string of 50 words found in another document too.

What repeats.py does with bytes, with words: windows of 50 words are brought together by their anchors (the 8 words in them with the least hash),
and the windows of one anchor are a context. Equal contexts of two documents are shared whole; where contexts of one anchor differ, their windows
are compared one by one. Words `[^\\x20\\x09-\\x0D]+` are compared with A-Z lower-cased and without the white space between them. Words, windows
and documents are named by 64 bits, contexts by their own and their anchor's; no text is removed by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.llm import scratch
from tidemart.llm.arrow_text import WordHasher, blocks, mix, pairwise, sliced, utf8
from tidemart.llm.windows import Polynomial, least_places, merged

WORDS, ANCHOR = 50, 8
#: Windows that are looked at together.
PART = 1 << 20


def contexts(h: np.ndarray, row: np.ndarray, words: int, anchor: int, poly: Polynomial) -> Iterator[tuple[np.ndarray, ...]]:
    """h: hashes of the words of some rows, row by row. (row, anchor's hash, hash of the content and of the anchor's place in it, first window,
    windows) of their contexts; windows count from the row's first word."""
    for at in range(0, len(h) - words + 1, PART):
        part, of = h[at : at + PART + words - 1], row[at : at + PART + words - 1]
        inside = np.flatnonzero(of[: len(part) - words + 1] == of[words - 1 :])
        grams = pairwise(part, anchor)
        place = least_places(grams, words - anchor + 1)[inside]
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        n = np.diff(begin, append=len(place))
        first, p = inside[begin], place[begin]
        e = mix(poly.of(poly.prefix(part), first, first + n - 1 + words) + (n * words + p - first).astype(np.uint64))
        yield of[first], grams[p], e, first + at - np.searchsorted(row, of[first]), n


def anchored(docs: DataFrame, words: int, anchor: int) -> DataFrame:
    """All contexts of docs (key, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, poly = WordHasher(), Polynomial()
        for b in sliced(batches):
            data, off = utf8(b.column(1))
            keys = b.column(0).to_numpy()
            for i, j in blocks(off):
                h, _, _, row = hasher.words(data, off[i : j + 1])
                for r, g, e, lo, n in contexts(h, row, words, anchor, poly):
                    cols = [keys[r + i], g.view(np.int64), e.view(np.int64), lo.astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "g", "e", "lo", "n"])

    return docs.select("key", "text").mapInArrow(find, "key long, g long, e long, lo int, n int")


#: Contexts with the same two are equal.
_KIND = ["g", "e"]


def passages(docs: DataFrame, words: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """docs (key long, text): key, starts, ends: the maximal runs [start, end) of words that are covered by strings of so many words
    which a document of another key has too, in order."""
    found = scratch.written(anchored(docs, words, min(anchor, words)), "word_anchors")
    # Two documents have two least and greatest names; written by itself, as in repeats.repeated_spans.
    several = [F.min("key").alias("a"), F.max("key").alias("z")]
    often = scratch.written(found.groupBy("g").agg(*several).where("a <> z").select("g"), "word_often")
    shared = scratch.written(found.join(often, "g"), "word_shared")
    scratch.drop(found)
    kinds = shared.groupBy(*_KIND).agg(*several, F.min_by("lo", "key").alias("lo"), F.max("n").alias("n"))  # all have the same n
    kinds = scratch.written(kinds.withColumn("c", F.monotonically_increasing_id()), "word_contexts")
    mixed = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.max(F.expr("a = z")).alias("open")).where("m > 1 AND open").select("g")
    mixed = scratch.written(mixed, "word_mixed")
    wanted = kinds.join(mixed, "g").select(F.col("a").alias("key"), F.struct("c", "a", "z", "lo", "n").alias("x"))
    wanted = wanted.groupBy("key").agg(F.collect_list("x").alias("cs"))  # a document's own contexts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, poly = WordHasher(), Polynomial()
        for b in sliced(batches):
            data, off = utf8(b.column(0))
            for i, j in blocks(off):
                h, _, _, row = hasher.words(data, off[i : j + 1])
                begins = np.searchsorted(row, np.arange(j - i))
                part = b.column(1).slice(i, j - i)
                c, a, z, lo, n = (part.flatten().field(k).to_numpy() for k in range(5))
                of = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # a context's windows
                first = np.repeat(begins[of] + lo, n) + t
                names = poly.of(poly.prefix(h), first, first + words).view(np.int64)
                cols = [*(np.repeat(x, n) for x in (c, a, z)), t.astype(np.int32), names]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["c", "a", "z", "t", "h"])

    windows = docs.join(wanted, "key").select("text", "cs").mapInArrow(cut, "c long, a long, z long, t int, h long")
    windows = scratch.written(windows, "word_windows")
    both = windows.groupBy("h").agg(F.min("a").alias("a"), F.max("z").alias("z")).where("a <> z").select("h")
    both = scratch.written(both, "word_both")
    hits = windows.where("a = z").join(both, "h").groupBy("c").agg(F.collect_list("t").alias("ts"))  # as many as an anchor has windows
    spans = kinds.join(scratch.written(hits, "word_hits"), "c", "left").where("a <> z OR ts IS NOT NULL")
    spans = scratch.written(spans.select(*_KIND, F.when(F.expr("a = z"), F.col("ts")).alias("ts")), "word_spans")
    whole = F.array(F.struct(F.lit(0).alias("t"), (F.col("n") - 1).alias("u")))  # windows from t to u
    each = F.coalesce(F.transform("ts", lambda t: F.struct(t.alias("t"), t.alias("u"))), whole)
    out = shared.join(spans, _KIND).select("key", "lo", F.explode(each).alias("x"))
    return merged(out.select("key", (F.col("lo") + F.col("x.t")).cast("long").alias("s"), (F.col("lo") + F.col("x.u") + words).cast("long").alias("e")), "long")

"""Suffix-array dedup: bytes covered by a string of 400 bytes that stands anywhere else.

The corpus is too large for one suffix array, so windows of 400 bytes that can be equal are brought together first:

1. Each window has an anchor, the 96-byte string in it with the least hash. It depends on the window's content alone, so equal windows
   have equal anchors at equal places. The consecutive windows of one anchor are a context: the text they cover.
2. Contexts are counted by anchor and content. Anchors that stand once are done. Equal contexts collapse into one with a weight.
3. Contexts that differ but have the same anchor may share some windows. They are cut into runs of ``steps`` windows, each named by the
   bytes that all its windows share. Equal runs are counted and one of them stands for all, with a weight; the different ones of a name
   are sorted together, and the equal windows among them are found by breadth-first backward extension on their Burrows-Wheeler
   transform (bwt.py), stopping at 400 bytes.
4. A name with very many different runs (a passage that half the corpus quotes) is not gathered: its runs are cut finer where they lie and
   named anew, down to single windows, which are equal or not.

What decides that bytes go is named by 128 bits: contents by two hashes, each a polynomial over the bytes with a base and values of its own;
documents by two hashes of id and text; a kind of context by a number that it gets when it is written. Names of 64 bits only bring things together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import passages, scratch
from tidemart.llm.arrow_text import mix, utf8
from tidemart.llm.bwt import repeated_windows
from tidemart.llm.tables import table
from tidemart.llm.windows import Polynomial, least_places, merged

LENGTH, ANCHOR = 400, 96
#: Windows in a run, level by level.
STEPS = (64, 16, 4, 1)
#: Different runs of one name that are gathered; bytes that one transform is made of.
MOST_RUNS, TRANSFORM_BYTES = 256, 1 << 17
#: Windows that are looked at together; a longer text is looked at in overlapping parts.
PART = 1 << 20


def contexts(b: np.ndarray, poly: Polynomial, second: Polynomial, length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor's hash, content's two hashes, first window, windows, bytes from there to the anchor) of the contexts of one text."""
    w = length - anchor + 1
    for at in range(0, len(b) - length + 1, PART):
        part = b[at : at + PART + length - 1]
        sums = poly.sums(part)
        m = len(part) - anchor + 1
        grams = mix((sums[anchor:] - sums[:-anchor]) * poly.unpower[:m])
        place = least_places(grams, w)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        n = np.diff(first, append=len(place))
        p = place[first]
        end = first + n - 1 + length
        yield grams[p], poly.of(sums, first, end), second.of(second.sums(part), first, end), first + at, n, p - first


def anchored(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """All contexts of docs (key, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly, second = Polynomial(), Polynomial(other=True)
        for b in batches:
            data, off = utf8(b.column(1))
            held, size = [], 0
            for i in np.flatnonzero(np.diff(off) >= length).tolist():
                for found in contexts(data[off[i] : off[i + 1]], poly, second, length, anchor):
                    held.append((np.full(len(found[0]), i), *found))
                    size += len(found[0])
                if size > 50_000:
                    yield batch(b.column(0), held)
                    held, size = [], 0
            if held:
                yield batch(b.column(0), held)

    def batch(keys: pa.Array, held: list) -> pa.RecordBatch:
        i, g, e, e2, lo, n, left = (np.concatenate(x) for x in zip(*held, strict=True))
        hashes = [pa.array(x.view(np.int64)) for x in (g, e, e2)]
        cols = [keys.take(pa.array(i)), *hashes, pa.array(lo), pa.array(n.astype(np.int32)), pa.array(left.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["key", "g", "e", "e2", "lo", "n", "left"])

    schema = "key struct<a: long, b: long>, g long, e long, e2 long, lo long, n int, left int"
    return docs.select("key", F.col("text").cast("string").alias("text")).mapInArrow(find, schema)


#: A run of n windows of context c from window a, whose first begins left bytes before the anchor; w: 2 if the run is known to stand elsewhere
#: (it serves others), else 1; name, content, content2: hashes.
RUNS = "c long, a int, n int, left int, w int, name long, content long, content2 long, text binary"
_names = [x.split()[0] for x in RUNS.split(", ")]
_kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _kinds, strict=True)], names=_names)


#: Runs with the same three are equal.
_EQUAL = ["name", "content", "content2"]


def cut_runs(c: int, a: int, n: int, left: int, w: int, text: bytes, steps: int, length: int, poly: Polynomial, second: Polynomial) -> Iterator[tuple]:
    """The runs of at most steps windows of a context or run; a window's place relative to the anchor decides where it belongs."""
    raw, t = np.frombuffer(text, np.uint8), 0
    sums, sums2 = poly.sums(raw), second.sums(raw)
    while t < n:
        o = left - t  # this window begins o bytes before the anchor
        part = o // steps
        m = min(n - t, o - part * steps + 1)
        core = np.array([left - part * steps]), np.array([left - ((part + 1) * steps - 1) + length])
        own = np.array([t]), np.array([t + m - 1 + length])
        h = poly.of(sums, *(np.concatenate(x) for x in zip(core, own, strict=True)))
        h = np.append(h, second.of(sums2, *own))
        name, content, content2 = mix(h + np.array([part * 7919 + steps, o * 7919 + m, o * 7919 + m], np.uint64)).view(np.int64).tolist()
        yield c, a + t, m, o, w, name, content, content2, text[t : t + m - 1 + length]
        t += m


def transformed(rows: Iterator[tuple], length: int) -> Iterator[tuple]:
    """rows (name, c, a, w, text): different runs, those of a name one after the other. (c, a, n) of the windows known to stand elsewhere."""
    waiting, size, current = [], 0, None

    def found() -> Iterator[tuple]:
        for (c, a, w, _), again in zip(waiting, repeated_windows([r[3] for r in waiting], length), strict=True):
            if w == 1:
                edge = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
                for s, e in edge.reshape(-1, 2).tolist():
                    yield c, a + s, e - s

    for name, *row in rows:
        if name != current and size >= TRANSFORM_BYTES:
            yield from found()
            waiting, size = [], 0
        current = name
        waiting.append(row)
        size += len(row[3])
    if waiting:
        yield from found()


def settled(runs: DataFrame, steps: int, length: int, most_runs: int) -> tuple[DataFrame, DataFrame]:
    """runs, a written table, which goes: (c, a, n) of the windows found to stand elsewhere, and finer runs of crowded names.

    Equal runs are counted without their texts, so that one that many contexts share is a sum, and the first of them stands for all. Only the
    texts of names with different runs, some of them not known yet, move on: each by its own (c, a), and then those of names with at most most_runs
    together. Crowded names are cut where their runs lie, and no task gathers them.
    """
    keys = runs.groupBy(*_EQUAL).agg(F.count(F.lit(1)).alias("times"), F.max("w").alias("w"), F.min(F.struct("c", "a")).alias("first"))
    keys = scratch.written(keys, "run_kinds")
    unknown = (F.col("times") == 1) & (F.col("w") == 1)
    names = keys.groupBy("name").agg(F.count(F.lit(1)).alias("different"), F.max(unknown).alias("open")).where("different > 1 AND open")
    names = scratch.written(names.select("name", "different"), "run_names")
    first = keys.join(names, "name").select("first.*", F.when(F.col("times") > 1, 2).otherwise(F.col("w")).alias("w"), "different")
    first = scratch.written(first, "first_runs")
    ours = scratch.written(runs.drop("w", "content", "content2").join(first, ["c", "a"]), "open_runs")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True))
        found = list(transformed(rows, length))  # three numbers a span
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), _kinds[:3], strict=True)], names=_names[:3])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly, second = Polynomial(), Polynomial(other=True)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = zip(*(part.column(k).to_pylist() for k in range(part.num_columns)), strict=True)
                yield _batch([x for r in rows for x in cut_runs(*r, steps, length, poly, second)])

    # Transforms take far longer than their bytes suggest: the number is stated, so that Spark doesn't bring small partitions together.
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = ours.where(F.col("different") <= most_runs).select("name", "c", "a", "w", "text").repartition(tasks, "name").sortWithinPartitions("name")
    equal = runs.where("w = 1").join(keys.where("times > 1").select(*_EQUAL), _EQUAL).select("c", "a", "n")
    known = scratch.written(equal.union(few.mapInArrow(transform, "c long, a int, n int")), "known")
    crowded = ours.where(F.col("different") > most_runs).select("c", "a", "n", "left", "w", "text")
    finer = scratch.written(crowded.mapInArrow(cut, RUNS), "runs")
    for done in (runs, keys, names, first, ours):
        scratch.drop(done)
    return known, finer


#: Contexts with the same four are equal: the anchor, the content, and where in it the anchor is.
_KIND = ["g", "e", "e2", "left"]


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most_runs: int = MOST_RUNS) -> DataFrame:
    """docs (key, text): key, s, e: bytes [s, e) of the text are windows that stand elsewhere too. Spans may overlap."""
    spark = docs.sparkSession
    levels = [min(x, length - anchor + 1) for x in STEPS]  # the windows of a run share bytes
    found = scratch.written(anchored(docs, length, anchor), "anchors")
    # Written by itself, so that the join below has no aggregate above its shuffle and Spark can split an anchor that many texts share.
    often = scratch.written(found.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g"), "often")
    repeated = scratch.written(found.join(often, "g"), "repeated")
    scratch.drop(found)
    kinds = repeated.groupBy(*_KIND).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "lo", "n")).alias("r"))
    kinds = scratch.written(kinds.withColumn("c", F.monotonically_increasing_id()), "contexts")
    mixed = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("times").alias("least")).where("m > 1 AND least = 1").select("g")
    mixed = scratch.written(mixed, "mixed")
    wanted = kinds.join(mixed, "g").select("c", "r.*", "left", F.least("times", F.lit(2)).cast("int").alias("w"))
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("c", "lo", "n", "left", "w")).alias("cs"))  # a document's own contexts

    def first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly, second = Polynomial(), Polynomial(other=True)
        for b in batches:
            for text, cs in zip(b.column(0), b.column(1), strict=True):
                raw, rows = memoryview(text.as_buffer()), []
                for x in cs.as_py():
                    part = bytes(raw[x["lo"] : x["lo"] + x["n"] - 1 + length])
                    rows += cut_runs(x["c"], 0, x["n"], x["left"], x["w"], part, levels[0], length, poly, second)
                yield _batch(rows)

    runs = scratch.written(docs.join(wanted, "key").select(F.col("text").cast("binary").alias("text"), "cs").mapInArrow(first_runs, RUNS), "runs")
    known, runs = settled(runs, levels[1], length, most_runs)
    for steps in [*levels[2:], 1]:
        if runs.isEmpty():
            break
        more, runs = settled(runs, steps, length, most_runs)
        known = known.union(more)
    whole = repeated.join(kinds.where("times > 1").select(*_KIND), _KIND).select("key", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + length).alias("e"))
    part = known.join(kinds.select("c", F.col("r.key").alias("key"), F.col("r.lo").alias("lo")), "c")
    part = part.select("key", (F.col("lo") + F.col("a")).alias("s"), (F.col("lo") + F.col("a") + F.col("n") - 1 + length).alias("e"))
    return whole.union(part)


def _document() -> Column:
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(2), "doc_id", "text").alias("b"))


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most_runs: int = MOST_RUNS, words: int = passages.WORDS) -> DataFrame:
    """docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, starts, ends (byte offsets of what goes), kept (binary: what stays), and
    n_passages, n_passage_words: runs of words, and the words in them, that are part of a string of so many words which another document has
    too (passages.py); of these nothing goes unless it has length bytes.

    Texts are judged as they come in. Null and empty texts, and those shorter than length, lose nothing. Rows with equal id and text are
    copies of each other, but no other documents to each other; each is returned. Other columns are ignored. An empty table gives no rows.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(_document().alias("key"), "doc_id", "text")
    with scratch.scope(docs.sparkSession) as own:
        spans = merged(repeated_spans(d.where(F.octet_length("text") >= length).select("key", "text"), length, anchor, most_runs))
        spans = scratch.written(spans, "spans")
        shared = passages.passages(d.where(F.octet_length("text") >= 2 * words - 1).select("key.a", "text").toDF("key", "text"), words)
        shared = shared.select(F.col("key").alias("name"), F.col("starts").alias("first"), F.col("ends").alias("last"))
        # One table, so that the texts are dealt out once more only; a document that loses bytes is still named by 128 bits.
        found = spans.join(shared, F.col("key.a") == F.col("name"), "full").select(F.coalesce("name", "key.a").alias("a"), "key.b", "starts", "ends", "first", "last")
        found = own.keep(scratch.written(found, "found"))
    raw = F.col("text").cast("binary")

    def kept(bounds) -> Column:
        part = lambda p: F.substring(raw, (p["e"] + 1).cast("int"), (p["s"] - p["e"]).cast("int"))
        return F.aggregate(bounds, F.lit(b""), lambda acc, p: F.concat(acc, part(p)))

    none = F.array().cast("array<bigint>")
    starts, ends = F.coalesce("starts", none), F.coalesce("ends", none)
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), ends).alias("e"), F.concat(starts, F.array(F.octet_length("text").cast("long"))).alias("s"))
    size = lambda starts, ends: F.aggregate(F.zip_with(starts, ends, lambda s, e: e - s), F.lit(0).cast("long"), lambda acc, x: acc + x)
    first, last = F.coalesce("first", none), F.coalesce("last", none)
    return d.join(found, (F.col("key.a") == F.col("a")) & (F.col("b").isNull() | (F.col("key.b") == F.col("b"))), "left").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        size(starts, ends).alias("n_removed"),
        F.size(starts).cast("long").alias("n_spans"),
        starts.alias("starts"),
        ends.alias("ends"),
        F.when(F.col("starts").isNull(), raw).otherwise(kept(gaps)).alias("kept"),
        F.size(first).cast("long").alias("n_passages"),
        size(first, last).alias("n_passage_words"),
    )


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that are part of a 400-byte string found elsewhere; runs of 50 words and more that other documents have too."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    more = [(F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("has_repeats")]
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *more, "n_passages", "n_passage_words")

"""Language identification with a blended-spectrum string kernel.

A text's features are which byte n-grams of 1 to 3 bytes occur in it (of its UTF-8, lower-cased): presence, not counts. The
kernel of two texts is the number of shared n-grams over the root of the product of their numbers, so each length's spectrum
blends into one. Some training documents are landmarks; the Nyström method maps a text to its kernel values with them, times
the inverse root of their own kernel matrix, and kernel ridge regression is fitted there, one versus rest. Only n-grams of
landmarks matter for those values, so the universe is theirs.

Fitting uses a bounded sample: about ``per_language`` documents of each language, chosen by a hash of the id, of which the
first ``landmarks`` of each are landmarks. The driver gets those alone; tasks map the sample and add up the normal equations, whose
size is that of the landmarks. Everything is scored. The product of landmark features and weights is taken once, so scoring a batch
is one matrix product of its presence matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.llm import scratch
from tidemart.llm.arrow_text import blocks, sliced, utf8
from tidemart.llm.tables import table

#: Documents of each language that the model is fitted on, and how many of them are landmarks.
PER_LANGUAGE, LANDMARKS = 600, 64
#: What both come to at most over all languages: with many of them each has fewer. As many languages as landmarks can be told apart.
SAMPLE, ALL_LANDMARKS = 60_000, 2048
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    codes: np.ndarray  # the universe: n-grams as integers, sorted; length n begins at BEGIN[n - 1]
    weights: np.ndarray  # universe x languages
    languages: list[str]


#: Where the codes of n-grams of each length begin.
BEGIN = np.array([0, 1 << 8, (1 << 8) + (1 << 16), (1 << 8) + (1 << 16) + (1 << 24)])


def features(codes: np.ndarray) -> np.ndarray:
    """Feature number (from 1) of each code, 0 for those outside the universe."""
    out = np.zeros(BEGIN[3], np.uint16 if len(codes) < 1 << 16 else np.int32)
    out[codes] = np.arange(1, len(codes) + 1)
    return out


def _codes(b: np.ndarray) -> list[np.ndarray]:
    """For each n, the code of the n-gram that begins at each byte of b."""
    x = b.astype(np.int32)
    two = (x[:-1] << 8) | x[1:]
    three = (two[:-1] << 8) | x[2:]
    return [x, two + np.int32(BEGIN[1]), three + np.int32(BEGIN[2])]


def presence(data: np.ndarray, offsets: np.ndarray, feature: np.ndarray, universe: int) -> np.ndarray:
    """rows x universe: 1 where the row has the n-gram. feature: features() of the universe."""
    n, d = len(offsets) - 1, universe + 1
    out = np.zeros(n * d, np.uint8)
    b, off = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    base = np.repeat(np.arange(n, dtype=np.int64) * d, np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(b))  # bytes to the row's end
    for k, code in enumerate(_codes(b)):
        inside = left[: len(code)] > k
        out[(base[: len(code)] + feature[code])[inside]] = 1
    return out.reshape(n, d)[:, 1:]


def kinds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of distinct n-grams of each row (128 at most), in the universe or not."""
    b, off = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint32) << np.uint32(25), np.diff(off))  # codes take 25 bits
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(b))
    keys = np.concatenate([(row[: len(c)] | c.astype(np.uint32))[left[: len(c)] > k] for k, c in enumerate(_codes(b))])
    keys.sort()
    return np.bincount(keys[np.diff(keys, prepend=~keys[:1]) != 0] >> np.uint32(25), minlength=len(off) - 1)


def _normal(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows over the root of n, their texts' numbers of n-grams."""
    return x.astype(np.float32) / np.sqrt(np.maximum(n, 1)).astype(np.float32)[:, None]


def _batch_rows(data: np.ndarray, offsets: np.ndarray, feature: np.ndarray, universe: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, normalised presence) of batches of bounded size."""
    for i, j in blocks(offsets, 1 << 18):
        for s in range(i, j, 128):
            e = min(s + 128, j)
            yield s, _normal(presence(data, offsets[s : e + 1], feature, universe), kinds(data, offsets[s : e + 1]))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, mark, codes (array<int>: the different n-grams of the text) of about per_language texts of each language: those whose hash is below
    the language's rate. Rows repeated with id and text are one. What a row holds is bounded by the n-grams that there are, not by its text."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    mark = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 40))
    rows = usable.join(F.broadcast(usable.groupBy("lang").count()), "lang").withColumn("mark", mark).where(F.col("mark") < share * (1 << 40))
    rows = rows.select("lang", "mark", "text").dropDuplicates(["lang", "mark"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            data, offsets = utf8(pa.array([x.lower() for x in b.column(2).to_pylist()], pa.large_string()))
            found = [np.unique(np.concatenate(_codes(data[x:y]))).astype(np.int32) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["lang", "mark", "codes"])

    return rows.mapInArrow(grams, "lang string, mark long, codes array<int>")


class Landmarks:
    """The landmarks' n-grams: which landmarks have each."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        """rows: each landmark's different codes, sorted."""
        every = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        self.codes, feature = np.unique(every, return_inverse=True)
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        order = np.argsort(feature, kind="stable")
        self.owner = owner[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(feature, minlength=len(self.codes)))])
        self.norm = 1 / np.sqrt(np.maximum([len(r) for r in rows], 1))

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows x landmarks: the kernel's values."""
        out = np.zeros((len(rows), len(self.norm)))
        for i, own in enumerate(rows):
            if len(self.codes) and len(own):
                at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
                at = at[self.codes[at] == own]
                n = self.begin[at + 1] - self.begin[at]
                place = np.arange(n.sum()) + np.repeat(self.begin[at] - np.cumsum(n) + n, n)
                out[i] = np.bincount(self.owner[place], minlength=len(self.norm)) * self.norm / np.sqrt(len(own))
        return out

    def weights(self, a: np.ndarray) -> np.ndarray:
        """n-grams x languages, of a: landmarks x languages. A part of the n-grams at a time."""
        out = np.zeros((len(self.codes), a.shape[1]), np.float32)
        scaled = a * self.norm[:, None]
        for u in range(0, len(self.codes), 4096):
            e = min(u + 4096, len(self.codes))
            first = self.begin[u:e]
            out[u:e] = np.add.reduceat(scaled[self.owner[first[0] : self.begin[e]]], first - first[0])
        return out


_PART = 1 << 14


def _normal_equations(rows: DataFrame, known: Landmarks, root: np.ndarray, counts: dict[str, int]) -> np.ndarray:
    """dimensions x (dimensions + languages): the weighted sums of phi phi' and phi y' over rows (lang, codes), phi being a row's kernel values
    times root. Each task sends its sums in parts, which are added in the order of the tasks."""
    spark = rows.sparkSession
    d, languages = root.shape[1], sorted(counts)
    place = {x: i for i, x in enumerate(languages)}
    shared = spark.sparkContext.broadcast((known, root))  # the landmarks' n-grams, landmarks squared

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, root = shared.value
        total = np.zeros((d, d + len(languages)))
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                phi = known.kernel([x.values.to_numpy() for x in part.column(1)]) @ root
                mine = part.column(0).to_pylist()
                light = phi / np.array([counts[x] for x in mine])[:, None]  # languages weigh alike
                total[:, :d] += light.T @ phi
                np.add.at(total.T, [d + place[x] for x in mine], light)
        flat = total.ravel()
        begins = range(0, len(flat), _PART)
        cols = [pa.array(begins, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(begins), pa.int64()), pa.array([flat[i : i + _PART] for i in begins], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["begin", "task", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for begin, task, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                held.setdefault(begin, []).append((task, v.values.to_numpy()))
        for begin, parts in held.items():
            total = np.sum([v for _, v in sorted(parts, key=lambda p: p[0])], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([begin], pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["begin", "task", "v"])

    schema = "begin long, task long, v array<double>"
    out = np.zeros(d * (d + len(languages)))
    for r in rows.select("lang", "codes").mapInArrow(sums, schema).repartition("begin").mapInArrow(add, schema).toLocalIterator():
        out[r.begin : r.begin + len(r.v)] = r.v
    return out.reshape(d, d + len(languages))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = 0.001) -> Model | None:
    """docs: doc_id, text, lang. None if no row has both text and lang. Raises if there are more languages than ALL_LANDMARKS."""
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    n_languages = len(named.select("lang").distinct().limit(ALL_LANDMARKS + 1).collect())
    if not n_languages:
        return None
    if n_languages > ALL_LANDMARKS:
        raise ValueError(f"more than {ALL_LANDMARKS} languages")
    per_language, landmarks = max(1, min(per_language, SAMPLE // n_languages)), max(1, min(landmarks, ALL_LANDMARKS // n_languages))
    with scratch.scope(docs.sparkSession):
        rows = scratch.written(training_rows(named, per_language), "sample")  # bounded by SAMPLE rows of different n-grams
        counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
        first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).where(F.col("_n") <= landmarks)
        chosen = first.select("mark", "lang", "codes").toPandas().sort_values(["mark", "lang"])  # ALL_LANDMARKS at most
        known = Landmarks([np.asarray(c, np.int64) for c in chosen["codes"]])
        values, vectors = np.linalg.eigh(known.kernel([np.asarray(c, np.int64) for c in chosen["codes"]]))
        keep = values > 1e-6 * max(values.max(), 1e-12)
        root = vectors[:, keep] / np.sqrt(values[keep])  # inverse root of the landmarks' kernel matrix
        d = root.shape[1]
        sums = _normal_equations(rows, known, root, counts)
    w = np.linalg.solve(sums[:, :d] + ridge * np.eye(d), sums[:, d:])
    codes, weights = known.codes, known.weights(root @ w)
    return Model(codes if len(codes) else np.array([32]), weights if len(codes) else np.zeros((1, len(counts)), np.float32), sorted(counts))


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1: the best one-versus-rest output, cut to that range). Only text is looked at.

    lang_pred is 'und' with score 0 for null texts, texts without a letter, or if there is no model. Columns of docs named
    like the two new ones are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score")
    at, names = docs.columns.index("text"), [*docs.columns, "lang_pred", "lang_score"]
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: n-grams of the landmarks x languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        feature = None if model is None else features(model.codes)
        for b in sliced(batches):
            texts = b.column(at).to_pylist()
            label, value = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if model is not None:
                data, offsets = utf8(pa.array([(x or "").lower() for x in texts], pa.large_string()))
                for s, p in _batch_rows(data, offsets, feature, len(model.codes)):
                    out = p @ model.weights
                    label[s : s + len(p)] = np.array(model.languages, object)[out.argmax(1)]
                    value[s : s + len(p)] = np.clip(out.max(1), 0, 1)
                bad = [i for i, x in enumerate(texts) if not x or not _letter.search(x)]
                label[bad], value[bad] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label, pa.string()), pa.array(value, pa.float64())], names=names)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(score, schema)


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    out = predicted(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))

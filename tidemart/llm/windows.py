"""Windows of texts, of bytes (repeats.py) or of words (passages.py): hashes, anchors, and the runs that spans make up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.llm.arrow_text import mix

_POSITION = np.uint64((1 << 21) - 1)


class Polynomial:
    """Hashes of substrings modulo 2**64: an odd base, random values of the bytes. other: a second one, with other values."""

    def __init__(self, other: bool = False) -> None:
        rng = np.random.default_rng(20250607 if other else 20240301)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0xAEF17502108EF2D9 if other else 0xD1342543DE82EF95
        self.power = self.unpower = np.zeros(0, np.uint64)

    def sums(self, b: np.ndarray) -> np.ndarray:
        return self.prefix(self.value[b])

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(values):
            n = max(1 << 16, 2 * len(values))
            for name, base in (("power", self.base), ("unpower", pow(self.base, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        out = np.empty(len(values) + 1, np.uint64)
        out[0] = 0
        np.cumsum(values * self.power[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((sums[last] - sums[first]) * self.unpower[first])


def least_places(grams: np.ndarray, w: int) -> np.ndarray:
    """Where the least of each w consecutive hashes is (the first of equals), from running minima of blocks of w in both directions."""
    m = len(grams)
    key = np.full(-(-m // w) * w, ~np.uint64(0))
    key[:m] = (grams & ~_POSITION) | np.arange(m, dtype=np.uint64)
    rows = key.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    return (np.minimum(back[: m - w + 1], ahead[w - 1 : m]) & _POSITION).astype(np.int64)


def merged(spans: DataFrame, key: str = "struct<a: long, b: long>") -> DataFrame:
    """key, starts, ends: the maximal runs of spans (key, s, e), in order. key: the type of the keys."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, ends = [], []
            for x in b.column(1):
                s, e = (x.values.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(s, kind="stable")
                s, reach = s[order], np.maximum.accumulate(e[order])
                new = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]]))
                starts.append(s[new])
                ends.append(np.append(reach[new[1:] - 1], reach[-1]))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, lists), pa.array(ends, lists)], names=["key", "starts", "ends"])

    gathered = spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("x"))  # one document's spans
    return gathered.mapInArrow(merge, f"key {key}, starts array<bigint>, ends array<bigint>")

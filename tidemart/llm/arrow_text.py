"""Text columns inside tasks: Arrow string arrays as numpy bytes, and hashes of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that numpy looks at together; a longer document is looked at by itself, whole.
BLOCK_BYTES = 1 << 20


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]]; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of batches, fewer at a time; they share the batches' memory, but what is made of them doesn't add up, and what Arrow
    keeps of former batches goes back to the machine: workers outlive their tasks."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        pa.default_memory_pool().release_unused()


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: a polynomial in an odd base modulo 2**64 over
    random values of the bytes, then mixed. Equal words have equal hashes wherever they stand."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20240229)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for c in range(ord("A"), ord("Z") + 1):
            self.value[c] = self.value[c + 32]
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.value[self.space] = 0
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)
        self.power = self.unpower = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, BLOCK_BYTES + 1)
            for name, base in (("power", self.base), ("unpower", self.inverse)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first byte, byte after the last, index of the row) of each word of the rows; bytes count from data's."""
        b, off = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = len(b)
        if not n:
            e = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), e, e, e
        self._powers(n + 1)
        in_word = ~self.space[b]
        start, end = in_word.copy(), in_word.copy()
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        start[1:] &= ~in_word[:-1]
        start[edge] = in_word[edge]
        end[:-1] &= ~in_word[1:]
        end[edge - 1] = in_word[edge - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        if not len(s):
            return np.zeros(0, np.uint64), s, e, s
        h = self.value[b]
        h *= self.power[:n]
        h = np.add.reduceat(h, s)
        h *= self.unpower[s]
        return mix(h), s + offsets[0], e + offsets[0], np.searchsorted(off, s, "right") - 1


def pairwise(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)

"""Repeated windows of a set of strings, by breadth-first backward extension on their Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of x (integers from 0, below 256) in the order of the first depth (or more) symbols that follow; ties by place."""
    n = len(x)
    padded = np.concatenate([x.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    reach = 8
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if reach >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - reach)] = rank[reach:] + 1
        key = (rank * (n + 1) + after).astype(np.uint64)
        reach *= 2


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string (each of at least length bytes), whether the window of length bytes at each place stands anywhere else in the strings.

    The transform is that of all strings, each closed by a mark. Boundaries between rows of the suffix order are found by the length
    of the prefix that the rows on both sides share, in rising order: extending backwards by a symbol c what is known to end at a
    boundary x gives the boundary of c's rows that enclose x, one symbol longer. The search stops at length: rows that no boundary
    parts from their neighbour share at least that much.
    """
    sizes = np.array([len(s) for s in strings])
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    marks = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(raw), bool)
    inside[marks] = False
    used = np.flatnonzero(np.bincount(raw[inside], minlength=256))
    dense = np.zeros(256, np.int64)
    dense[used] = np.arange(1, len(used) + 1)
    x = np.where(inside, dense[raw], 0)  # 255 different bytes at most in UTF-8 texts
    n, sigma = len(x), len(used) + 1
    order = suffix_order(x, length)
    last = x[order - 1]
    seen = np.zeros((n + 1, sigma), np.int32)  # seen[i, c]: how often c stands in the first i symbols of the transform
    seen[np.arange(1, n + 1), last] = 1
    np.cumsum(seen, axis=0, out=seen)
    total = seen[n]
    begin = np.concatenate([[0], np.cumsum(total)[:-1]]).astype(np.int32)
    parted = np.zeros(n + 1, bool)
    new = np.unique(begin[1:])
    new = new[new < n]
    parted[new] = True
    parted[0] = True
    for _ in range(length - 1):
        if not len(new):
            break
        counts = seen[new]
        within = (counts > 0) & (counts < total)
        within[:, 0] = False
        found = (counts + begin)[within]
        found = found[~parted[found]]
        parted[found] = True
        new = np.unique(found)
    alike = ~parted[1:n]  # rows i and i + 1 share length symbols
    again = np.zeros(n, bool)
    again[order[:-1][alike]] = True
    again[order[1:][alike]] = True
    return [again[e - s : e - length + 1] for s, e in zip(sizes, marks, strict=True)]

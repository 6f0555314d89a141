"""Passages that several documents have, against a plain version: short words, copies, edits, repeated ids, nulls, other case and white space."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

import brute
from tidemart.llm import passages, repeats
from tidemart.llm.windows import Polynomial


def shared_words(rows: list[tuple], words: int) -> list[tuple[int, int]]:
    """(runs, words in them) of each row (id, text)."""
    texts = [brute.words(t) for _, t in rows]
    of = defaultdict(set)
    for (i, t), x in zip(rows, texts, strict=True):
        for k in range(len(x) - words + 1):
            of[tuple(x[k : k + words])].add((i, t or ""))
    out = []
    for x in texts:
        mask = [False] * len(x)
        for k in range(len(x) - words + 1):
            if len(of[tuple(x[k : k + words])]) > 1:
                mask[k : k + words] = [True] * words
        out.append((sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask)), sum(mask)))
    return out


def some_rows() -> list[tuple]:
    rng = random.Random(11)
    make = lambda n, words=("a", "bc", "Dé", "e.", "f", "ghi"): " ".join(rng.choices(words, k=n))
    shared, same = make(14), make(40)
    rows = [None, "", "a", make(4), " \t\n", make(30), f"{make(9)} {shared} {make(9)}", f"{shared.upper()}\n{make(5)}", shared.replace(" ", "\t \n"), same, same]
    rows += [f"{shared[:-1]}x {make(3)}", f"{make(20)} {shared} {make(3)} {shared}", "a " * 25, "a " * 6 + make(20), make(12, ("z",)) + " y " + make(12, ("z",))]
    for _ in range(40):
        edited = same.split()
        edited[rng.randrange(40)] = "new"
        rows.append(" ".join(edited))
    return [*enumerate(rows), (9, same), (9, shared), (None, shared), (None, same)]


@pytest.mark.parametrize("words", [5, 8, 12])
def test_passages_against_a_plain_version(spark, words):
    rows = some_rows()
    want = sorted((str(i), *n) for (i, _), n in zip(rows, shared_words(rows, words), strict=True))
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, 12, words=words).collect()
    assert sorted((str(r.doc_id), r.n_passages, r.n_passage_words) for r in got) == want and sum(n > 0 for _, n, _ in want) > 30


def test_passages_in_parts(monkeypatch):
    monkeypatch.setattr(passages, "PART", 7)
    h, row = np.random.default_rng(3).integers(0, 1 << 62, 60, dtype=np.uint64), np.repeat([2, 5, 6], [9, 33, 18])
    found = [np.concatenate(x) for x in zip(*passages.contexts(h, row, 12, 4, Polynomial()), strict=True)]
    windows = sorted((r, lo + k) for r, lo, n in zip(found[0], found[3], found[4], strict=True) for k in range(n))
    assert windows == [(5, k) for k in range(22)] + [(6, k) for k in range(7)]


def test_planted_passages_of_over_50_words_under_400_bytes(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8))) for _ in range(3000)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows, planted = [], set()
    for k in range(30):
        passage = make(51 + k % 10)
        for _ in range(2):
            planted.add(len(rows))
            rows.append((len(rows), f"{make(rng.randrange(200))} {passage} {make(rng.randrange(200))}"))
    rows += [(len(rows) + k, make(rng.randrange(1, 500))) for k in range(60)]
    got = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.n_passages} == planted
    assert all(r.n_passages == 1 and 51 <= r.n_passage_words <= 62 for i, r in got.items() if i in planted)
    assert sum(r.n_removed > 0 for r in got.values()) < len(planted) / 2  # most are shorter than what goes

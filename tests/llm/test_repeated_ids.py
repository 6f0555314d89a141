"""Rows whose ids repeat, crowded shingles, scopes in threads, flat vocabularies."""

from __future__ import annotations

import random
import sys
import threading
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tidemart.llm import lm, ngram_join, repeats, scratch


def text(seed, n=60):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(400)], k=n))


def plain_rows(rows, percent, k):
    """(doc_id, class_id, component_id, n) of each row, each a node of its own."""
    nodes = brute.components({i: t for i, (_, t) in enumerate(rows)}, percent, k)
    of, sets = {}, {}
    for i, (n, c) in nodes.items():
        if rows[i][0] is not None and n:
            of.setdefault(c, []).append(rows[i][0])
    same = brute.components({i: t for i, (_, t) in enumerate(rows)}, 100, k)
    for i, (n, c) in same.items():
        if rows[i][0] is not None and n:
            sets.setdefault(c, []).append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        n = nodes[i][0]
        out.append((d, n, None if d is None else min(sets[same[i][1]]) if n else d, None if d is None else min(of[nodes[i][1]]) if n else d))
    return sorted(out, key=str)


def test_one_id_and_two_texts(spark):
    a, b = text(1), text(2)
    rows = [(5, a), (5, b), (6, a + " more"), (9, b + " more"), (5, a), (3, "other words here"), (7, None), (7, "")]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in got), key=str) == plain_rows(rows, 90, 3)
    assert {r.component_id for r in got if r.doc_id in (6, 9)} == {5} and len(got) == len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_repeated_ids(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        t = text(rng.randrange(25))
        words = t.split()
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = f"x{rng.randrange(3)}"
        rows.append((rng.randrange(40), " ".join(words)))
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 80, 3).collect()
    # Null-free, so each row is a node; links through rows with a null id don't count in either.
    assert sorted(((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in got), key=str) == plain_rows(rows, 80, 3)


def test_a_shingle_that_many_unlike_groups_share_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROSS", 4)
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 0)
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = text(1000 + i // 2, 30).split()
        if i % 2:
            base[rng.randrange(20)] = "changed"
        rows.append((i, " ".join(["very", "often", "quoted", "words", *base])))
    want = brute.components(dict(rows), 80, 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 80, 3).collect()}
    assert got == want and len({c for _, c in want.values()}) < 60


def test_a_large_family_of_near_copies_takes_pairs_in_proportion(spark, monkeypatch):
    """One text in five has one word changed and the others three: those are similar enough to the former alone, so a pivot of theirs links few."""
    rng, base = random.Random(6), [f"w{i}" for i in range(200)]
    changed = [rng.sample(range(5, 195, 6), 1 if i % 5 == 0 else 3) for i in range(240)]
    rows = [(i, " ".join(f"x{i}_{k}" if k in c else w for k, w in enumerate(base))) for i, c in enumerate(changed)]
    written, made = scratch.written, []

    def counted(df, name):
        out = written(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(scratch, "written", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 80, 5).collect()}
    assert got == brute.components(dict(rows), 80, 5) and {c for _, c in got.values()} == {0}
    assert sum(made) < 10 * len(rows)


def test_repeats_of_rows_with_equal_and_null_ids(spark):
    shared = "".join(random.Random(9).choices("abcdefgh ", k=500))
    own = ["".join(random.Random(20 + i).choices("ijklmnop ", k=450)) for i in range(4)]
    rows = [(1, own[0] + shared), (1, own[1] + shared), (None, own[2]), (None, shared + own[3]), (1, own[0] + shared), (2, None)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((str(r.doc_id), r.n_removed, bytes(r.kept).decode()) for r in got)
    assert kept == sorted([("1", 950, ""), ("1", 950, ""), ("1", 500, own[1]), ("None", 0, own[2]), ("None", 500, own[3]), ("2", 0, "")])


def test_scopes_of_threads_are_their_own(spark):
    begun, ended = threading.Event(), threading.Event()
    held = {}

    def other():
        with scratch.scope(spark):
            begun.wait(60)
            held["table"] = scratch.written(spark.range(3), "mine")
            ended.wait(60)
            held["count"] = held["table"].count()

    t = threading.Thread(target=other)
    t.start()
    with scratch.scope(spark):
        begun.set()
        while "table" not in held:
            pass
        scratch.written(spark.range(2), "yours")
    ended.set()
    t.join()
    assert held["count"] == 3


def test_frequent_words_of_a_flat_top(spark):
    counts = spark.createDataFrame([(i * 7919, -1, 100) for i in range(5000)] + [(10**9 + i, -1, 200) for i in range(10)] + [(2 * 10**9, -1, 3)], "word long, form long, c long")
    for most in (5, 10, 500, 4000, 6000):
        got = [r.c for r in lm.frequent(counts, most).collect()]
        assert len(got) <= most and sorted(got, reverse=True) == sorted([200] * min(10, len(got)) + [100] * (len(got) - 10) if len(got) <= 5010 else [200] * 10 + [100] * 5000 + [3], reverse=True)
        assert len(got) >= min(most, 5011) - 20
    few = spark.createDataFrame([(i, -1, 5) for i in range(6)], "word long, form long, c long")
    assert 2 <= lm.frequent(few, 3).count() <= 3


def test_many_languages(spark):
    """Two hundred languages: each of its own syllables. The driver holds landmarks and sums of their size alone."""
    from tidemart.llm import langid

    rng = random.Random(12)
    rows = []
    for k in range(200):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüéèñ", k=rng.randrange(2, 5))) for _ in range(30)]
        rows += [(1000 * k + i, " ".join(rng.choices(own, k=25)), f"l{k}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 1000 < 6"))
    assert len(model.languages) == 200 and model.weights.shape == (len(model.codes), 200)
    got = langid.predicted(df.where("doc_id % 1000 >= 6"), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) == 380

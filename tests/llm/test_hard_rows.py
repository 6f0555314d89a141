"""Very long texts, null and repeated ids, ties and clashing names through the operators and stages that other tests don't take there."""

from __future__ import annotations

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline

from tidemart.llm import chat, decontaminate, gru, lm, ngram_join, order_minhash, packing, repeats, token_files, tokens
from tidemart.llm.arrow_text import WordHasher

SF = "/root/testdata/sf0.001"


def long_text(seed, n):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(5000)], k=n))


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.word_bpe())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def hard(spark):
    """Two long near copies, an exact copy, repeated ids with equal and with different texts, null ids, nothing, one long run without a space."""
    a = long_text(1, 30_000)
    rows = [(1, a), (2, a + " end"), (3, a), (4, long_text(2, 50)), (4, long_text(3, 50)), (4, long_text(2, 50)), (None, long_text(2, 50)), (None, None), (5, ""), (6, "x" * 200_000)]
    return rows, spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, _key string, ids_crc32 int")


def test_ngram_join(hard):
    rows, df = hard
    got = ngram_join.linked(df).collect()
    want = brute.components({i: t for i, (_, t) in enumerate(rows)}, 90, 3)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, want[i][0]) for i, (d, _) in enumerate(rows))
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2, 3, 6)} == {1: 1, 2: 1, 3: 1, 6: 6}
    assert {r.component_id for r in got if r.doc_id == 4} == {4} and {r.component_id for r in got if r.doc_id is None} == {None}


def test_token_files(spark, hard, encode, tmp_path):
    rows, df = hard
    token_files.write_tokens(df, str(tmp_path / "t"), tokens.word_bpe(), 2, parts=3)
    got = token_files.documents(token_files.blocks(spark, str(tmp_path / "t"))).collect()
    ids = Counter((d, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for d, t in rows for e in [encode(t)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ids
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered[:-1]]).tolist()
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known)


def test_packing(hard, encode):
    rows, df = hard
    placed = packing.packed(packing.pieces(df, tokens.word_bpe(), 2)).collect()
    want = Counter()
    for d, t in rows:
        want[d] += len(encode(t))
    have = Counter()
    for r in placed:
        have[r.doc_id] += r.length
    assert have == want
    room = {}
    for r in placed:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_decontamination_of_long_texts(spark, hard):
    rows, df = hard
    words = rows[0][1].split()
    items = [("long", " ".join(words[15_000:15_040])), ("short", "w1"), ("none", None), (None, " ".join(words[29_990:]))]
    got = decontaminate.hits(df, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert len(got) == len(rows)
    by_text = {}
    for d, t in rows:
        n, hit, found = brute.benchmark_hits(t or "", [("null" if i is None else i, x) for i, x in items])
        by_text.setdefault(d, []).append((n, hit, sorted(found)))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, list(r["items"])))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in by_text.items()}


def test_repeats_of_long_texts(spark):
    rng = random.Random(5)
    part = "".join(rng.choices("abcdefgh ", k=150_000))
    rows = [(1, part + "".join(rng.choices("ijkl", k=1000))), (2, "".join(rng.choices("mnop", k=1000)) + part), (3, "z" * 5000)]
    got = {r.doc_id: (r.n_removed, len(r.kept)) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (150_000, 1000), 2: (150_000, 1000), 3: (5000, 0)}


def test_fingerprints_of_long_texts(hard):
    rows, df = hard
    got = order_minhash.fingerprints(df).collect()
    want = Counter((d, len(t or ""), tuple(brute.order_minhash(t))) for d, t in rows)
    assert Counter((r.doc_id, r.n_chars, tuple(r.sketch)) for r in got) == want


def test_chats_with_ties_and_repeated_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, None, "user", long_text(7, 20_000)), (3, 0, None, None)]
    got = chat.maximal_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id for r in got} == {1, 3} and len([r for r in got if r.conv_id == 1]) == 3


# Stages -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["near_copies", "benchmarks", "personal"])
def test_stages_keep_columns_named_like_their_own(spark, hard, name):
    rows, df = hard
    mine = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("mine").alias("_key"), F.lit("too").alias("_KEY_"), F.lit(7).alias("component_id"))
    out = dict(corpus_pipeline.STAGES)[name](spark, mine, SF)
    found = out.collect()
    assert out.columns == mine.columns and {(r["_key"], r["_KEY_"], r["component_id"]) for r in found} == {("mine", "too", 7)}
    want = {"near_copies": {1, 4, 5, 6, None}, "benchmarks": {1, 2, 3, 4, 5, 6, None}, "personal": {1, 2, 3, 4, 5, 6, None}}
    assert {r.doc_id for r in found} == want[name] and len(found) == {"near_copies": 6 + 1, "benchmarks": 10, "personal": 10}[name]


# Language model -------------------------------------------------------------------------------------------------------------


def test_scores_are_the_models_and_the_shares_of_rare_words(spark):
    """With no round of training the weights are those that the counts give, so a score can be put together by hand."""
    shape = gru.Shape(heads=64, members=8, forms=8, hidden=4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6, None), (10**6 + 1, "Unseen words ÄÖ"), (10**6 + 1, "Unseen words ÄÖ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda d: d % 5 == 0
    got = lm.scored(df, F.col("doc_id") % 5 == 0, shape, rounds=0).collect()

    hasher, form, split = WordHasher(), {}, []
    for _, text in rows:
        parts = list(lm.tokenised(pa.array([text or ""]), hasher, shape.forms))
        own = [(int(h), int(f)) for _, _, hs, fs in parts for h, f in zip(hs, fs)]
        form.update(own)
        split.append([h for h, _ in own])
    counts = Counter(h for (d, _), s in zip(rows, split) if not held(d) for h in s)
    ends = sum(not held(d) for d, _ in rows)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    top = sorted(counts, key=lambda h: (-counts[h], signed(h)))[: shape.heads]
    symbol = {h: i for i, h in enumerate(top)}
    rest = np.zeros((shape.forms, 2))
    for h, c in counts.items():
        if h not in symbol:
            rest[form[h]] += c, 1
    symbols = np.concatenate([[counts[h] for h in top], rest[:, 0], [ends]])
    flat = gru.initial(shape, symbols)
    want = Counter()
    for (d, _), s in zip(rows, split):
        ids = np.array([symbol.get(h, shape.heads + form[h]) for h in s], np.int64)
        score = gru.log_probabilities(shape, flat, [ids])[0] / np.log(10)
        score += sum(np.log10(counts[h] + 1) - np.log10(rest[form[h]].sum() + 1) for h in s if h not in symbol)
        want[d, round(float(score), 2)] += 1
    have = Counter((r.doc_id, round(r.score, 2)) for r in got)
    near = lambda a, b: a[0] == b[0] and abs(a[1] - b[1]) <= 0.02 + 1e-5 * abs(b[1])
    assert len(got) == len(rows) and all(any(near(k, w) for w in want) for k in have)

"""The pipeline against a plain version of each of its stages."""

from __future__ import annotations

import random
import sys
import zlib
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline

from tidemart.llm import langid, pii, tokens

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {d: t for d, t in docs.items() if t and any(c.isalpha() for c in t)}
    kept = {d: kept[d] for d, (_, c) in brute.components(kept, 80, 5).items() if c == d}
    for d in list(kept):
        n, hit, _ = brute.benchmark_hits(kept[d], items)
        if hit and 20 * hit >= n:
            del kept[d]
    from tokenizers import Tokenizer

    encode, ids = Tokenizer.from_file(tokens.word_bpe()).encode, {}
    for d, text in kept.items():
        out, end, base = "", 0, pii.detect(text)
        for s, e, k in sorted(base + pii.hidden(text, base)):
            if s >= end:
                out += text[end:s] + f"<{pii.KINDS[k].upper()}>"
            end = max(end, e)
        ids[d] = [*encode(out + text[end:], add_special_tokens=False).ids, 2]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(ids) and len(ids) < len(docs)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_language_rejects_what_no_learned_language_fits(spark):
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 10))) for _ in range(n)) for n in (40, 40, 300)]
    odd = ["Это простой русский текст, который модель никогда не видела. " * 4, "这是一个模型从未见过的中文文本，里面没有任何学过的语言。" * 4, "Αυτό είναι ένα απλό ελληνικό κείμενο. " * 3, "Привет мир 2024", *noise]
    clean = ["Is", "Is and", "Iechä.", "Aieau pour", "Cióngaieción de", "Is and retitioning ouen the of"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(-1 - i, t) for i, t in enumerate(odd)] + [(10**6 + i, t) for i, t in enumerate(clean)]
    more = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, more, SF).collect()}
    assert not {i for i in kept if i < 0} and {i for i in kept if i >= 10**6} == {10**6 + i for i in range(len(clean))}
    assert {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)} == {i for i in kept if 0 <= i < 10**6}


def test_language_without_labels_keeps_rows_with_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "Привет", None), (3, "12 !", None), (4, None, None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()} == {1, 2}


def test_distinct_ngrams_of_texts():
    texts = [b"", b"a", b"aaaa", "été été".encode(), b"ab", b"the end of it all"]
    offsets = np.cumsum([0, *map(len, texts)])
    want = [len({t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}) for t in texts]
    assert langid.kinds(np.frombuffer(b"".join(texts), np.uint8), offsets).tolist() == want
    for t, n in zip(texts, want, strict=True):
        assert langid.kinds(np.frombuffer(t, np.uint8), np.array([0, len(t)])).tolist() == [n]


def test_near_copies_of_repeated_and_null_ids(spark):
    rng = random.Random(9)
    one, two, three = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(5, one), (5, two), (5, one), (3, one + " end"), (9, two), (None, one), (None, one), (7, three), (8, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, lang string, component_id int")
    out = corpus_pipeline.near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    want = [(None, one), (None, one), (3, one + " end"), (5, two), (6, ""), (7, three), (8, None)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)

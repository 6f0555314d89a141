"""Operators on small tables with nulls, empty texts, repeated rows, ties and clashing column names, against plain versions."""

from __future__ import annotations

import math
import random
import sys
import time
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tidemart.llm import (
    arrow_text, bwt, chat, decontaminate, gru, langid, lm, ngram_join, order_minhash, packing, pii, registry, repeats, token_files, tokens,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n int, key string, lang string"


def some_texts(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(20, 90))) for _ in range(n // 3)]
    out = []
    for t in base:
        w = t.split()
        out += [t, " ".join(w[:-1] + ["zz"]), " ".join(w[: len(w) // 2] + rng.choices(vocabulary, k=10))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \t\n", "one", "One TWO", "one two", "!!! 123", "a b c", "A b\tc", "ab" * 3000, "été à la plage 漢字 🙂", *some_texts()]
    rows = [(i * 7 % 101, t, i, "k", "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize(("percent", "k"), [(90, 3), (80, 5)])
def test_ngram_join(docs, percent, k):
    want = brute.components({r.doc_id: r.text for r in docs.collect()}, percent, k)
    got = by_id(ngram_join.linked(docs, percent, k))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_ngram_join_nulls_and_empty_tables(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "a b c")]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (3, 3), (5, 3), (5, 3)]
    assert ngram_join.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.data())
def test_bits_round_trip(bits, values, data):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    a = data.draw(st.integers(0, len(ids)))
    assert token_files.unpack(packed, bits, a, len(ids) - a).tolist() == ids[a:].tolist()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.word_bpe())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_is_the_library(library):
    import pyarrow as pa

    texts = ["Hello, WORLD's end!!", "don't", "été ÉTÉ ß ÿ", "a<|endoftext|>b", "<|ENDOFTEXT|>", "Éa H̱", "tab\tnew\nline x y", "x1y22", "漢字🙂", "İstanbul Σας", "", None, "a" * 500, "it's/it'll", "ẞ Ǆ"]
    got = list(tokens.Encoder(tokens.word_bpe()).encode_all(pa.array(texts)))
    assert [g.tolist() for g in got] == [library(t)[:-1] for t in texts]
    assert [g.tolist() for g in tokens.Encoder(tokens.word_bpe(), by_word=False).encode_all(pa.array(texts))] == [library(t)[:-1] for t in texts]


def test_token_files(spark, docs, library, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, path, tokens.word_bpe(), 2, parts=3)
    blocks = token_files.blocks(spark, path)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    ids = [library(r.text) for r in rows]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.documents(blocks).collect())
    starts = np.cumsum([0] + [len(x) for x in ids]).tolist()
    assert got == [(s, r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for s, r, x in zip(starts, rows, ids)]
    flat = [i for x in ids for i in x]
    part = sorted((r.start, r.ids) for r in token_files.token_range(blocks, 40, 400).collect())
    assert [i for _, x in part for i in x] == flat[40:400]
    token_files.write_tokens(docs.limit(0), str(tmp_path / "e"), tokens.word_bpe(), 2)
    assert token_files.documents(token_files.blocks(spark, str(tmp_path / "e"))).count() == 0


def test_first_fit_decreasing_is_the_plain_one():
    rng = random.Random(2)
    lengths = np.array([rng.randrange(1, 101) for _ in range(300)])
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    rooms, want = [], {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(rooms) if r >= lengths[i]), len(rooms))
        if b == len(rooms):
            rooms.append(100)
        want[i] = (b, 100 - rooms[b])
        rooms[b] -= lengths[i]
    assert [want[i] for i in range(300)] == list(zip(bins.tolist(), offsets.tolist()))


def test_packing(spark, docs, library):
    placed = packing.packed(packing.pieces(docs, tokens.word_bpe(), 2, length=128, with_ids=True), length=128, group_pieces=20)
    rows, ids = placed.collect(), {r.doc_id: library(r.text) for r in docs.collect()}
    held, filled = Counter(), {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        held[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert held == {d: len(x) for d, x in ids.items()}
    for parts in filled.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 128
    whole = packing.sequences(placed).collect()
    assert sum(len(r.ids) for r in whole) == sum(map(len, ids.values())) and all(len(r.ids) <= 128 for r in whole)
    assert packing.packed(packing.pieces(docs.limit(0), tokens.word_bpe(), 2)).count() == 0


def test_personal_data_base_patterns():
    kinds = lambda t: [(t[s:e], pii.KINDS[k]) for s, e, k in pii.detect(t)]
    assert kinds("x a.b@c.de, q@@r.st @n.o p@q") == [("a.b@c.de", "email")]
    assert kinds("a@b.c@d.e") == [("a@b.c", "email")]
    assert kinds("1.2.3.4 256.1.1.1 1.2.3 1.2.3.4.5.6.7.8") == [("1.2.3.4", "ip"), ("1.2.3.4", "ip"), ("5.6.7.8", "ip")]
    assert ("4111 1111-1111 1111", "card") in kinds("no 4111 1111-1111 1111!") and kinds("4111111111111112") == []
    assert kinds("+1 (988) 555-2485, +12 3") == [("+1 (988) 555-2485", "phone")]
    assert kinds("") == []


def test_personal_data_behind_disguises():
    def found(t):
        base = pii.detect(t)
        return [(t[s:e], pii.KINDS[k]) for s, e, k in pii.hidden(t, base)]

    assert found("mail joe (at) foo [dot] com now") == [("joe (at) foo [dot] com", "email")]
    assert found("é joe at foo dot com") == [("joe at foo dot com", "email")]
    assert found("plus one two three four five six seven eight nine zero one") == [("plus one two three four five six seven eight nine zero one", "phone")]
    assert found("one nine two dot one six eight dot one dot two") == [("one nine two dot one six eight dot one dot two", "ip")]
    assert found("４１１１ １１１１ １１１１ １１１１") == [("４１１１ １１１１ １１１１ １１１１", "card")]
    assert found("jоe@fоо.com") == [("jоe@fоо.com", "email")]
    assert found("double four one triple one one one one one one one one one one one") == []
    assert found("we met at noon. one two three dots") == [] and found("die Straße at the end of thing") == []


def test_personal_data_base_is_the_plain_patterns():
    rng = random.Random(6)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "255", "256", "+", "4111 1111 1111 1111", "49927398716123", "-", " ", "(", ")", "joe", "x_y", "%", "12", "7", "+44 20 7946 0958", ".", ".."]
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert pii.detect(t) == brute.personal(t), t


DISGUISES = [
    "joe@foo.com", "joe[@]foo[.]com", "joe@foo[.]com", "joe  at  foo  dot  com", "joe (at)\nfoo (dot) com", "joe @ foo . com", "joe&#64;foo.com", "jo\u200be@foo.com",
    "joe [at] foo.com", "joe.x (at) mail (dot) foo (dot) org", "joe{at}foo{dot}net", "JOE AT FOO DOT COM", "joe arroba foo punto es", "joe (at) foo punkt de", "ｊｏｅ@ｆｏｏ.com",
    "jоe@foo.com", "joe&commat;foo&period;com",
]


@pytest.mark.parametrize("disguise", DISGUISES)
def test_disguised_addresses_are_found_whole(disguise):
    for before, after in (("", ""), ("write to ", " now"), ("é, ", ", or not."), ("(", ")")):
        t = before + disguise + after
        base = pii.detect(t)
        whole = (len(before), len(before) + len(disguise), 0)
        assert whole in base + pii.hidden(t, base), t


def test_spelled_numbers_in_four_languages():
    lists = ["zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"]
    for names in map(str.split, lists):
        t = "call plus " + " ".join(names[int(d)] for d in "49301234567") + " or"
        assert [(t[s:e], pii.KINDS[k]) for s, e, k in pii.hidden(t, pii.detect(t))] == [(t[5:-3], "phone")]


@pytest.mark.parametrize("clean", [
    "we met at noon. dot com is a word", "look at the point of it", "at home . and so on", "lunch @ noon . then we go", "f(x) [.] g", "un deux pas", "einen punkt zu", "a (at) b", "price @ 5 . ok", "uno dos tres", "", "@", " at ", "(dot)(at)(dot)",
])
def test_clean_texts_stay_clean(clean):
    assert pii.hidden(clean, pii.detect(clean)) == []


def test_very_long_texts_take_time_in_proportion():
    for unit in (" x dot y a.", "a.", "joe at ", "(at)", "1 2 3 ", "one two ", "a@", "+1 ", " dot ", "\u200b1.", "joe (at) foo (dot) com "):
        t = unit * (1_000_000 // len(unit))
        begun = time.process_time()
        base = pii.detect(t)
        pii.hidden(t, base)
        assert time.process_time() - begun < 40, unit


def test_personal_data_frames(spark):
    d = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a@b.cd x", 5), (3, "a@b.cd x", 5), (4, "no", None)], "doc_id long, text string, base int")
    assert sorted((r.doc_id, len(r.base)) for r in pii.spans(d).collect()) == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 0)]
    assert [r.text for r in pii.masked(d).orderBy("doc_id").collect()] == [None, "", "<EMAIL> x", "<EMAIL> x", "no"]
    assert pii.spans(d.limit(0)).count() == 0


def test_benchmark_hits(spark):
    rng = random.Random(4)
    w = [f"v{i}" for i in range(40)]
    items = [(1, " ".join(w[:20])), (2, "Short ITEM"), (3, None), (4, "..."), (None, "nothing here"), (5, " ".join(["aa"] * 15)), (2, "Short ITEM")]
    texts = [None, "", "xx " + " ".join(w[3:16]).upper() + ", yy", " ".join(w[:12]), "a short-item!", "nothing here", "aa " * 30, " ".join(w), "shorté item"]
    texts += [" ".join(rng.choices(w, k=50)) for _ in range(5)]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, texts[2], 1)], "doc_id long, text string, word int")
    b = spark.createDataFrame(items, "item_id long, text string")
    named = [("null" if i is None else i, t) for i, t in items]
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        got = decontaminate.hits(d, b, broadcast_bytes=limit).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            assert (r.n_words, r.n_hit, r["items"]) == brute.benchmark_hits(texts[r.doc_id], named), texts[r.doc_id]
    assert all(r.n_hit == 0 for r in decontaminate.hits(d, b.limit(0)).collect()) and decontaminate.hits(d.limit(0), b).count() == 0


def test_benchmark_hits_of_words_whose_lower_case_depends_on_neighbours(spark):
    for passage in ("ΟΔΟΣ.ΑΒ", "Κ.Σ.", "ΟΔΟΣ'ΑΒ x"):
        d = spark.createDataFrame([(1, f"a {passage} b"), (2, "none of it")], "doc_id long, text string")
        found = {r.doc_id: r.items for r in decontaminate.hits(d, spark.createDataFrame([(5, passage)], "item_id long, text string")).collect()}
        assert found == {1: ["5"], 2: []}, passage


def repeat_texts():
    rng = random.Random(5)
    make = lambda n: "".join(rng.choices("abcdé ", k=n))
    shared, other = make(80), make(45)
    out = [None, "", "a" * 200, make(300), make(50) + shared + make(50), shared[10:] + make(30), make(9) + other, other + other, "xy" * 60]
    same = make(150)
    return [*out, same, same, *[make(rng.randrange(3, 9)) + shared[:60] + make(rng.randrange(3, 9)) for _ in range(30)]]


@pytest.mark.parametrize("most_runs", [256, 1])
def test_repeated_strings(spark, most_runs):
    texts = repeat_texts()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, key int, s string")
    masks = brute.repeated(texts, 40)
    got = by_id(repeats.without_repeats(d, 40, 12, most_runs))
    for i, (t, m) in enumerate(zip(texts, masks)):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        r = got[i]
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(raw), int(m.sum()), raw[~m].tobytes()), i
        assert r.n_spans == int((np.diff(m.astype(int), prepend=0) == 1).sum())
    assert repeats.without_repeats(d.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=40), min_size=1, max_size=8), st.integers(2, 6))
def test_windows_of_the_transform(strings, length):
    raw = [s.encode() for s in strings]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b, again in zip(raw, bwt.repeated_windows(raw, length)):
        assert again.tolist() == [seen[b[i : i + length]] > 1 for i in range(len(b) - length + 1)]


def test_order_minhash(spark, docs):
    got = by_id(order_minhash.fingerprints(docs))
    for r in docs.collect():
        assert got[r.doc_id].sketch == brute.order_minhash(r.text), r.text
        assert got[r.doc_id].n_chars == len(r.text or "")
    near = lambda a, b: spark.range(1).select(order_minhash.likeness(order_minhash.sketch(F.lit(a)), order_minhash.sketch(F.lit(b)))).head()[0]
    text = " ".join(f"w{i}" for i in range(300))
    assert near(text, text) == 1 and near("", "") == 1 and near(text, "") == 0
    changed = text.replace("w7 ", "zz ").replace("w150 ", "")
    assert 0.6 < near(text, changed) < 1
    swapped = " ".join(f"w{i}" for i in [*range(150, 300), *range(150)])
    assert near(text, swapped) < near(text, changed)


@pytest.mark.parametrize("n", [40, 80, 300])
def test_moved_blocks_lower_the_likeness(n):
    # Half of the pairs of chosen elements lie on both sides of the cut and turn around.
    rng, likes = random.Random(n), []
    for _ in range(20):
        w = [f"{rng.getrandbits(40):x}" for _ in range(n)]
        likes.append(brute.likeness(brute.order_minhash(" ".join(w)), brute.order_minhash(" ".join(w[n // 2 :] + w[: n // 2]))))
    assert 0.3 < np.mean(likes) < 0.62


@pytest.mark.parametrize("alphabet", ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "".join(map(chr, range(0x4E00, 0x5200))), "abcdefghijklmnopqrstuvwxyz"])
def test_one_more_character_in_a_text_without_spaces(alphabet):
    rng = random.Random(5)
    for at in (0, 1, 1500):
        t = "".join(rng.choices(alphabet, k=3000))
        assert brute.likeness(brute.order_minhash(t), brute.order_minhash(t[:at] + "x" + t[at:])) > 0.8


def test_order_minhash_query(spark, docs, tmp_path):
    (tmp_path / "sf").mkdir()
    docs.where("doc_id IS NOT NULL").write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = by_id(order_minhash.op8_order_minhash(spark, str(tmp_path / "sf")))
    for r, after in zip(rows, rows[1:] + rows[:1]):
        text, other = r.text or "", after.text or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        own, new, next_ = (brute.order_minhash(t) for t in (text, edited, other))
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(text), brute.sha(edited))
        assert g.fingerprint == "".join(f"{x % (1 << 64):016x}" for x in own) and g.edited_fingerprint == "".join(f"{x % (1 << 64):016x}" for x in new)
        assert math.isclose(g.near_edited, brute.likeness(own, new)) and math.isclose(g.near_next, brute.likeness(own, next_))


def test_next_document_of_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(5, "b"), (5, "a"), (None, "n"), (9, None), (None, "m"), (1, "z")], "doc_id long, text string")
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    for parts in (1, 4):
        got = {(r.doc_id, r.text): r.next_text for r in order_minhash.with_next(d, ["text"], parts).collect()}
        assert got == {(9, ""): "b", (5, "b"): "a", (5, "a"): "z", (1, "z"): "n", (None, "n"): "m", (None, "m"): ""}


def test_next_document(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    want = {r.doc_id: n.text for r, n in zip(rows, rows[1:] + rows[:1])}
    for parts in (1, 5):
        got = order_minhash.with_next(docs.select("doc_id", "text"), ["text"], parts).collect()
        assert {r.doc_id: r.next_text for r in got} == want
    assert order_minhash.with_next(docs.select("doc_id", "text").limit(0), ["text"]).count() == 0


def test_chat_snapshots(spark):
    chats = {1: ["a", "b", "c"], 2: ["a", "b"], 3: ["a"], 4: ["x", "y"], 5: ["x", "y"], 6: ["a", "c"], 7: [None, ""], None: ["x"]}
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x, 9) for c, xs in chats.items() for t, x in enumerate(xs)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    got = chat.maximal_conversations(d).orderBy("conv_id", "position").collect()
    assert {r.conv_id for r in got} == {1, 4, 6, 7}
    one = [r for r in got if r.conv_id == 1]
    assert "".join(r.segment for r in one) == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n"
    assert [r.start for r in one] == [0, one[0].length, one[0].length + one[1].length] and [r.is_target for r in one] == [False, True, False]
    assert chat.maximal_conversations(d.limit(0)).count() == 0


def test_language(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predicted(d, langid.fit(d.where(langid.remainder(F.col("doc_id"), 3) != 1))).where(langid.remainder(F.col("doc_id"), 3) == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.lang_score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !", None), (4, "a", "en"), (5, "the end of it all", "en")], "doc_id long, text string, lang string")
    labels = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predicted(odd, langid.fit(odd)).collect()}
    assert [labels[i][0] for i in (1, 2, 3)] == ["und"] * 3 and labels[1][1] == 0 and labels[5][0] == "en"
    assert langid.fit(odd.limit(0)) is None and langid.predicted(odd, None).where("lang_pred <> 'und'").count() == 0


def test_language_is_kernel_ridge_regression(spark):
    """Against the plain method: kernels of every pair of texts, Nystroem features, ridge regression."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(90).select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    docs = docs.union(docs.limit(3))  # repeated rows are one
    model, rows = langid.fit(docs, landmarks=5), langid.training_rows(docs).toPandas().sort_values(["mark", "lang"], ignore_index=True)
    texts = {frozenset(brute.ngrams(r.text)): r.text for r in docs.collect()}
    sets = [set(c) for c in rows["codes"]]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    marks = [sets[i] for i in np.flatnonzero(rows.groupby("lang").cumcount() < 5)]
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k)
    keep = values > 1e-6 * values.max()
    phi = np.array([[kernel(a, b) for b in marks] for a in sets]) @ (vectors[:, keep] / np.sqrt(values[keep]))
    y = (rows["lang"].to_numpy()[:, None] == np.array(model.languages)).astype(float)
    d = (1 / y.sum(0))[y.argmax(1)][:, None]
    w = np.linalg.solve((phi * d).T @ phi + 0.001 * np.eye(phi.shape[1]), (phi * d).T @ y)
    want = {t: np.clip(s.max(), 0, 1) for t, s in zip((texts[frozenset(s)] for s in sets), phi @ w)}
    got = {r.text: r.lang_score for r in langid.predicted(docs, model).collect()}
    assert len(want) > 50 and all(abs(got[t] - s) < 2e-3 for t, s in want.items())


def test_language_scores_do_not_depend_on_the_batch(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "is"), (2, "a"), (3, "é"), (4, "the end " * 200_000)], "doc_id long, text string").withColumn("lang_pred", F.lit(1))
    alone = [langid.predicted(odd.where(f"doc_id = {i}"), model).head() for i in (1, 2, 3, 4)]
    together = sorted(langid.predicted(odd.coalesce(1), model).collect())
    assert [(r.doc_id, r.lang_pred, round(r.lang_score, 5)) for r in alone] == [(r.doc_id, r.lang_pred, round(r.lang_score, 5)) for r in together]


def test_language_model(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(100_001, None), (100_002, " \n "), (None, "the the the")], "doc_id long, text string")
    d = d.union(extra)
    got = lm.scored(d, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, share=1.0).collect()
    assert len(got) == 203
    texts = {r.doc_id: [*brute.words(r.text), None] for r in d.collect()}
    held = {i for i in texts if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, ws in texts.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, r.doc_id in held)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.scored(d.limit(0), F.lit(False)).count() == 0


def test_language_model_learns_from_all_training_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, "x"), (7, None)], "doc_id long, text string"))
    seen = [(r.doc_id, r.text) for k in range(lm.ROUNDS) for r in lm.part(d, k, lm.ROUNDS, lm.TRAIN_SHARE).collect()]
    assert Counter(seen) == Counter((r.doc_id, r.text) for r in d.collect())


def test_long_texts_make_no_steps_of_their_own():
    # 256 texts of one symbol each and a long one of another: the long one's tail must not undo what the others taught.
    shape = gru.Shape(heads=8, members=4, forms=2, hidden=3)
    texts = [np.full(12, k % 4) for k in range(255)] + [np.full(9000, 5)]
    flat = gru.initial(shape, np.ones(shape.symbols))
    (new, seen), (single, _) = gru.train(shape, flat, [texts]), gru.train(shape, flat, [texts], least=1)
    fit = lambda w: gru.log_probabilities(shape, w, texts[:255]).sum()
    assert seen == 255 * 13 + 9001 and fit(new) > fit(single)


def test_probabilities_of_all_continuations_sum_to_one():
    # Of a text, P(text . symbol) over all symbols, plus P(text . end), is P(text): computed from whole-text scores alone.
    shape = gru.Shape(heads=8, members=4, forms=2, hidden=3)
    flat = np.random.default_rng(1).normal(0, 0.5, shape.size()).astype(np.float32)
    score = lambda texts: gru.log_probabilities(shape, flat, [np.array(t, np.int64) for t in texts])

    def begins(t):  # log P of the symbols of t, without an end: from a plain recurrence
        v, h, out, x = shape.views(flat.astype(np.float64)), np.zeros(shape.hidden), 0.0, shape.end
        sigmoid = lambda y: 1 / (1 + np.exp(-y))
        for y in t:
            n, g, a = shape.hidden, v["inp"][x], h @ v["rec"]
            z, r = sigmoid(g[:n] + a[:n]), sigmoid(g[n : 2 * n] + a[n : 2 * n])
            h = h + z * (np.tanh(g[2 * n :] + r * a[2 * n :]) - h)
            p = np.exp(h @ v["cls"] + v["cls_b"])
            c = y // 4 if y < 8 else y - 8 + 2
            out += np.log(p[c] / p.sum())
            if y < 8:
                q = np.exp(h @ v["mem"][c] + v["mem_b"][c])
                out += np.log(q[y % 4] / q.sum())
            x = y
        return out

    for t in ([], [3], [9, 0, 7, 7]):
        every = [begins([*t, y]) for y in range(shape.symbols)]
        assert np.isclose(np.exp(every).sum(), np.exp(begins(t)))
        assert np.isclose(score([t])[0], every[shape.end], atol=1e-4)


def test_gradients():
    shape = gru.Shape(heads=8, members=4, forms=2, hidden=3)
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, shape.end, n) for n in (5, 3, 0, 7)]
    flat = gru.initial(shape, np.ones(shape.symbols)).astype(np.float64)
    loss = lambda w: -gru.log_probabilities(shape, w.astype(np.float64), texts, steps=20).sum()
    # One step of Adam over all positions moves each weight against its gradient's sign, which finite differences give too.
    one, _ = gru.train(shape, flat.astype(np.float32), [texts], steps=20, rate=1e-3, least=10**9)
    step, eps = one - flat.astype(np.float32), 1e-4
    for i in rng.choice(len(flat), 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += eps
        down[i] -= eps
        slope = (loss(up) - loss(down)) / (2 * eps)
        assert abs(slope) < 0.02 or np.sign(step[i]) == -np.sign(slope), (i, slope, step[i])
    trained, seen = gru.train(shape, flat, [texts] * 60, steps=20)
    assert seen == 60 * sum(len(t) + 1 for t in texts) and loss(trained) < 0.6 * loss(flat)
    # Windows carry the state: their length changes nothing in scores.
    a, b = (gru.log_probabilities(shape, flat.astype(np.float32), texts, steps=s) for s in (2, 20))
    assert np.allclose(a, b, atol=1e-4)


def test_an_encoders_blocks_are_small():
    """A worker keeps what malloc took for the largest block; blocks of 2 MB took 74 MB here."""
    enc, texts = tokens.Encoder(tokens.word_bpe()), pa.array([" ".join(f"word{(i * 7919 + j) % 5000}" for j in range(3000)) for i in range(200)])
    tracemalloc.start()
    try:
        n = sum(map(len, enc.encode_all(texts)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == sum(len(enc._encode(t)) for t in texts.to_pylist()) and most < 40e6


def test_batches_of_texts_leave_arrows_pool():
    """What Arrow had taken for a batch stayed with the worker."""
    released = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: released.append(1)))
        batch = pa.RecordBatch.from_arrays([pa.array(range(5))], names=["x"])
        rows = [b.column(0).to_pylist() for b in arrow_text.sliced(iter([batch, batch]), 3)]
    assert rows == 2 * [[0, 1, 2], [3, 4]] and len(released) == 2


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    order = sorted(want.columns)
    tidy = lambda cols, data: sorted(str(tuple(r[cols.index(c)] for c in order)) for r in data)
    assert sorted(df.columns) == order and tidy(df.columns, [tuple(r) for r in df.collect()]) == tidy(want.columns, want.fetchall())

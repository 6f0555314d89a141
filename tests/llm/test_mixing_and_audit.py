"""Mixing and the filter audit against plain versions; nulls, empty texts, repeats, hot sources and copies."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemart.llm import filter_audit, mixing, registry

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, n int, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Mixing -----------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """sizes: {source: words}. One after another: share what is left by weight, stop those above their most, again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, budget = {}, set(names), share * sum(sizes.values())
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            budget -= target[s]
        open_ -= over
    return target


def mix_is_right(rows, got, cut=True):
    """rows: (doc_id, text, source, ...)."""
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r[1])
    want = plain_targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[2], size(r[1])) for r in rows)
    taken, broken = defaultdict(int), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        ratio = r.target / r.source_size if r.source_size else 0
        broken[r.source] += r.size > 0 and (r.taken % r.size != 0 or not ratio - 1 < r.taken / r.size < ratio + 1)
    for s in sizes:
        if cut:
            assert abs(taken[s] - want[s]) <= 1
        assert broken[s] <= (1 if cut else 0)


def test_mix_of_the_given_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    got = mixing.op11_mix(spark, SF).collect()
    mix_is_right(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op11_mix(spark, SF).collect()))


def words(n):
    return " ".join(["w"] * n)


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, words(int(rng.integers(0, 40))), rng.choice(["hot", "hot", "hot", "b", "é", "Z", "漢", ""]), "en", 1, "x") for i in range(900)]
    rows += [(None, words(7), "hot", "en", 1, "x")] * 300 + [(None, words(k), None, None, 1, None) for k in range(30)] + [(5, words(3), "b", "en", 1, "x")] * 5000
    rows += [(1000, None, "empty", "en", 1, "x"), (1001, "", "empty", "en", 1, "x"), (1002, " \t\n\x0b", "empty", "en", 1, "x"), (1003, words(20000), "long", "en", 1, "x"), (1004, "a b c", "long", "en", 1, "x")]
    return [tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows]


@pytest.mark.parametrize("cut", [True, False])
def test_mix_of_nulls_repeats_and_hot_sources(spark, cut):
    """More documents than a bucket holds, so the tree has several rounds; equal rows by the thousand; sources that take all they may."""
    rows = odd_rows()
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(df, cut=cut).collect()
    mix_is_right(rows, got, cut)
    dealt_otherwise = mixing.mixed(df.repartition(7, "n", "text"), cut=cut).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, dealt_otherwise))
    assert mixing.mixed(df.limit(0)).collect() == []


def test_mix_keeps_expectations(spark):
    """Over many seeds each document is taken as often as its source's share says."""
    size = np.array([1, 2, 3, 5, 8, 13, 21, 34] * 4)
    totals = np.zeros(len(size))
    for seed in range(2000):
        mass, last = mixing.rounded(size, size * 0.3, np.random.default_rng(seed))
        assert abs(mass.sum() - size.sum() * 0.3) < 1e-9
        whole = np.delete(np.arange(len(size)), last) if last >= 0 else np.arange(len(size))
        assert all(m in (0, s) for m, s in zip(mass[whole], size[whole]))
        totals += mass
    assert np.abs(totals / 2000 / size - 0.3).max() < 0.05


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.integers(0, 1000), min_size=1, max_size=9))
def test_plain_targets_reach_the_budget(sizes):
    t = plain_targets(sizes)
    assert abs(sum(t.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(t[s] <= 2 * sizes[s] + 1e-9 for s in t)


# Filter audit -------------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """docs: (doc_id, text, source, lang, ...), labels: (doc_id, quality, toxic)."""
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    marked = []
    for d, t, _, lang, *_ in docs:
        t, w = t or "", WORD.findall(t or "")
        fails = {
            f for f, bad in (
                ("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))),
                ("E", d is not None and d > least[t]),
            ) if bad
        }
        marked.append((lang or "", fails, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {m[0] for m in marked}:
        rows = [m for m in marked if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for i, f in enumerate(order):
                gone = lambda m: bool(m[1] & set(order[:i]))  # noqa: B023, E731
                here = [m for m in rows if f in m[1] and not gone(m)]
                out[part, order, i + 1] = [
                    sum(not (m[1] & set(order[: i + 1])) for m in rows), len(here), sum(f in m[1] and gone(m) for m in rows), sum(m[1] == {f} for m in rows),
                    sum(m[2] for m in here), sum(m[3] for m in here),
                ]
                shapley[part, f] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in df.collect()}


def test_audit_of_the_given_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    want = plain_audit(docs, labels)
    assert audit_rows(filter_audit.op12_filter_audit(spark, SF)) == want
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = con.sql(registry.oracle_sql()["op12_filter_audit"])
    at = [sql.columns.index(c) for c in ("part", "filter_order", "step", *filter_audit.COUNTS, "shapley")]
    assert {(r[at[0]], r[at[1]], r[at[2]]): tuple(r[i] for i in at[3:]) for r in sql.fetchall()} == want


def test_audit_of_nulls_copies_and_ties(spark):
    long_ = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, None, "s", None, 1, "x"), (2, "", "s", "", 1, "x"), (None, "", "s", "en", 1, "x"), (None, long_, "s", "en", 1, "x"), (7, long_, "s", "en", 1, "x"), (7, long_, "s", "de", 1, "x"),
        (8, long_, "s", "en", 1, "x"), (9, long_.upper(), "s", "en", 1, "x"), (10, long_ + " #", "s", "en", 1, "x"), (11, words(30000), "s", "en", 1, "x"), (12, "Ä B", "s", "de", 1, "x"),
        (13, "\x1c\x85  A" + " b" * 200, "s", "de", 1, "x"),
    ] + [(100 + i, "copy me", "s", "fr", 1, "x") for i in range(400)] + [(50, "copy me", "s", "fr", 1, "x")] * 3
    labels = [(7, 1, 0), (7, 0, 1), (8, 1, 1), (None, 1, 1), (9, None, 1), (50, 1, None), (100, 1, 0), (12345, 1, 1)]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit_rows(filter_audit.audited(df, lab)) == plain_audit(rows, labels)
    assert audit_rows(filter_audit.audited(df, lab.limit(0))) == plain_audit(rows, [])
    assert filter_audit.audited(df.limit(0), lab).collect() == []

"""Whitening against numpy's own eigenvectors, exact polynomials against plain ones; ties, repeats, nulls, large numbers."""

from __future__ import annotations

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemart.llm import charpoly, whitening

SF = "/root/testdata/sf0.001"


def plain_polynomial(m):
    """det(x - m) by Faddeev and LeVerrier, constant first."""
    d = len(m)
    a = [[Fraction(v) for v in row] for row in m]
    c, b = [Fraction(1)], [[Fraction(i == j) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        ab = [[sum(a[i][x] * b[x][j] for x in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(ab[i][i] for i in range(d)) / k)
        b = [[ab[i][j] + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(v) for v in reversed(c)]


def gram(rows):
    x = np.array(rows, object)
    return (x.T @ x).tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6).flatmap(lambda d: st.lists(st.lists(st.integers(-(10**6), 10**6), min_size=d, max_size=d), min_size=1, max_size=8)))
def test_polynomial_is_exact(rows):
    m = gram(rows)
    got = charpoly.remaindered({p: charpoly.residues(m, p) for p in charpoly.enough_primes(m)})
    assert got == plain_polynomial(m)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=6), st.integers(0, 99))
def test_roots_and_vectors(values, seed):
    """Matrices with known eigenvalues, repeated and zero ones too: a permuted block of them, mixed by an integer rotation."""
    d = len(values)
    rng = np.random.default_rng(seed)
    m = np.diag(np.array(values, object))
    for _ in range(3 if d > 1 else 0):  # (3, 4, 5) rotations times 5: eigenvalues grow by 25
        i, j = rng.choice(d, 2, replace=False)
        g = np.diag(np.array([5] * d, object))
        g[i, i], g[i, j], g[j, i], g[j, j] = 3, -4, 4, 3
        m = g @ m @ g.T
    factor = 25 ** (3 if d > 1 else 0)
    m = m.tolist()
    roots = charpoly.largest_roots(charpoly.remaindered({p: charpoly.residues(m, p) for p in charpoly.enough_primes(m)}), 4)
    want = [v * factor for v in sorted(values, reverse=True) if v][:4]
    assert [round(r / (1 << charpoly.PLACES), 6) for r in roots] == want
    v = charpoly.vectors(m, roots)
    a = np.array(m, float)
    assert np.allclose(v @ v.T, np.eye(len(roots)), atol=1e-14)
    assert np.allclose(a @ v.T, v.T * np.array(want, float), atol=1e-9 * max([1, *want]))


def test_close_roots_are_told_apart():
    m = [[10**18, 1, 0], [1, 10**18, 0], [0, 0, 1]]
    roots = charpoly.largest_roots(charpoly.remaindered({p: charpoly.residues(m, p) for p in charpoly.enough_primes(m)}), 2)
    assert [r >> charpoly.PLACES for r in roots] in ([10**18 + 1, 10**18 - 1], [10**18 + 1, 10**18 - 2], [10**18, 10**18 - 1], [10**18, 10**18 - 2])
    v = charpoly.vectors(m, roots)
    assert np.allclose(np.abs(v), [[math.sqrt(0.5), math.sqrt(0.5), 0]] * 2, atol=1e-15) and v[0, 0] * v[0, 1] > 0 > v[1, 0] * v[1, 1]


def plain(rows, most=4):
    """{(place of row, component): (n, deviation, |whitened|, explained)} of rows (id, vector)."""
    ok = [(i, [math.floor(256 * float(c)) for c in v]) for i, (_, v, *_) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, d = len(fit), len(fit[0])
    s = [sum(col) for col in zip(*fit)]
    z = np.array(fit, float) - np.array(s) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in ok:
        for k in range(min(most, d)):
            if e[k] > 1e-13 * e[0]:
                out[i, k + 1] = (n, sum((n * a - b) ** 2 for a, b in zip(x, s)), abs((np.array(x) - np.array(s) / n) @ u[:, k] / math.sqrt(e[k])), e[k] / e.sum())
    return out


def test_whitening_of_the_given_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    want = plain(rows)
    got = whitening.op13_whiten(spark, SF).collect()
    place = {r[0]: i for i, r in enumerate(rows)}
    assert len(got) == len(want) == 4 * len(rows)
    for r in got:
        n, deviation, w, share = want[place[r.vec_id], r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - w) < 1e-9 and abs(r.explained / share - 1) < 1e-9 and r.identity_error < 1e-9
    first = {}
    for r in got:  # one sign for all rows
        x = np.array(rows[place[r.vec_id]][1])
        first.setdefault(r.component, []).append((x, r.whitened))
    for pairs in first.values():
        a = np.array([x for x, _ in pairs])
        a = np.hstack([a, np.ones((len(a), 1))])
        coefficients = np.linalg.lstsq(a, np.array([w for _, w in pairs]), rcond=None)[0]
        assert np.abs(a @ coefficients - np.array([w for _, w in pairs])).max() < 0.2  # floors alone keep it from being linear


SCHEMA = "vec_id long, embedding array<double>, n int, x string"


def test_unusable_repeated_and_clashing_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0, -0.25], 1, "a"), (2, [0.5, 1.0, -0.25], 1, "a"), (2, [0.5, 1.0, -0.25], 1, "a"), (None, [-0.0, 0.001, 3.0], 1, "b"), (3, None, 1, "b"), (4, [], 1, "b"),
        (5, [1.0, None, 2.0], 1, "b"), (6, [1.0, nan, 2.0], 1, "b"), (7, [inf, 1.0, 2.0], 1, "b"), (8, [2.0, 0.0, 1.0], 1, "b"), (9, [1.0, 2.0], 1, "b"), (2**53 + 1, [0.7, -9.0, 4.0], 1, "c"),
    ]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain([r if r[0] != 9 else (9, None) for r in rows])
    assert len(got) == len(want) == 6 * 3
    assert sorted({str(r.vec_id) for r in got}) == sorted({"1", "2", "None", "8", str(2**53 + 1)})
    plain_rows = sorted((str(rows[i][0]), k, n, dev, round(w, 9), round(s, 9)) for (i, k), (n, dev, w, s) in want.items())
    assert sorted((str(r.vec_id), r.component, r.n, int(r.deviation), round(abs(r.whitened), 9), round(r.explained, 9)) for r in got) == plain_rows


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "")], [(1, [1.0, 2.0], 1, ""), (2, [1.0, 2.0], 1, "")]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_large_entries_and_few_dimensions(spark):
    """Products beyond doubles and longs stay exact; one dimension has one component."""
    big = [(i, [float((i * 7919 % 13) * 10**9 + i), float(i * 10**6)], 1, "") for i in range(20)]
    got = whitening.whitened(spark.createDataFrame(big, SCHEMA)).collect()
    want = plain(big)
    assert sorted((r.vec_id, r.component, int(r.deviation)) for r in got) == sorted((i, k, v[1]) for (i, k), v in want.items())
    assert max(r.identity_error for r in got) < 1e-9
    one = whitening.whitened(spark.createDataFrame([(i, [float(i % 3)], 1, "") for i in range(9)], SCHEMA)).collect()
    assert len(one) == 9 and {round(abs(r.whitened), 6) for r in one} == {0.0, round(math.sqrt(1.5), 6)}


def test_a_repeated_vector_counts_once(spark):
    base = [(i, [float(i % 5), float(i % 7), float(i % 3)], 1, "") for i in range(50)]
    once = {(r.vec_id, r.component): r.whitened for r in whitening.whitened(spark.createDataFrame(base, SCHEMA)).collect()}
    more = spark.createDataFrame(base + [(100 + i, base[3][1], 1, "") for i in range(300)], SCHEMA)
    for r in whitening.whitened(more).where("vec_id < 100").collect():
        assert abs(r.whitened - once[r.vec_id, r.component]) < 1e-12

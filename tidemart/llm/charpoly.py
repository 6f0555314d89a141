"""Exact eigenvalues of symmetric, non-negative integer matrices: characteristic polynomials, their largest roots, and eigenvectors.

The polynomial is taken modulo primes below 2^31 by reduction to Hessenberg form; residues of enough primes give its integers
by Chinese remaindering. All roots are real, so the number of roots above a point is exactly the number of sign changes of the
polynomial shifted there (Descartes); halving intervals by that count isolates the largest roots, and by the polynomial's sign
narrows them to far more digits than a double has. Eigenvectors come from inverse iteration at such a root in long decimals.
Everything here grows with the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import comb

import numpy as np

#: Binary places of roots, beyond those of the matrix's integers; bits after which an isolated root is narrow enough.
PLACES, BITS = 128, 112
Matrix = list[list[int]]


def primes(below: int = 1 << 31) -> Iterator[int]:
    """Primes under below, falling. The bases decide every number under 3.2e9."""
    for n in range(below - 1, 2, -2):
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        if all(n % p for p in (3, 5, 7, 11, 13)) and all(_passes(n, a, d, s) for a in (2, 3, 5, 7)):
            yield n


def _passes(n: int, a: int, d: int, s: int) -> bool:
    x = pow(a, d, n)
    return x in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(s - 1))


def enough_primes(matrix: Matrix) -> list[int]:
    """Primes whose product exceeds twice any coefficient: the k-th is at most comb(d, k) (trace / d)^k, as no eigenvalue is negative."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    mean = -(-trace // max(d, 1)) + 1
    bound = 2 * max(comb(d, k) * mean**k for k in range(d + 1)) + 1
    out, product = [], 1
    for p in primes():
        if product > bound:
            return out
        out.append(p)
        product *= p
    raise ValueError("out of primes")


def hessenberg(h: np.ndarray, p: int) -> np.ndarray:
    """h modulo p in Hessenberg form, similar to h. Entries stay below 2^31, so products fit in 64 bits."""
    h = h.copy()
    d = len(h)
    for m in range(1, d - 1):
        rows = np.flatnonzero(h[m:, m - 1])
        if not len(rows):
            continue
        i = m + int(rows[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(1)) % p
    return h


def residues(matrix: Matrix, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo p, constant first."""
    d = len(matrix)
    h = hessenberg(np.array([[v % p for v in row] for row in matrix], np.int64).reshape(d, d), p)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for m in range(d):
        nxt = np.roll(polys[m], 1)
        nxt = (nxt - polys[m] * h[m, m]) % p
        chain, factors = 1, np.zeros(m, np.int64)
        for i in range(m - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            factors[i] = chain * int(h[i, m]) % p
        polys[m + 1] = (nxt - (factors[:, None] * polys[:m] % p).sum(0)) % p
    return polys[d].tolist()


def remaindered(found: dict[int, list[int]]) -> list[int]:
    """The integers whose residues found has by prime, each between minus and plus half the product of the primes."""
    product = 1
    for p in found:
        product *= p
    basis = {p: (product // p) * pow(product // p, -1, p) for p in found}
    sums = [sum(r * basis[p] for p, r in zip(found, rs, strict=True)) % product for rs in zip(*found.values(), strict=True)]
    return [s - product if 2 * s > product else s for s in sums]


def _changes(coefficients: list[int], at: int) -> int:
    """Sign changes of the polynomial shifted to at: its roots above at, each as often as it is one."""
    c = coefficients[:]
    n = len(c)
    for i in range(n - 1):
        for j in range(n - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(coefficients: list[int], at: int) -> int:
    out = 0
    for c in reversed(coefficients):
        out = out * at + c
    return out


def largest_roots(coefficients: list[int], most: int) -> list[int]:
    """The most largest positive roots, falling, each as often as it is one, in units of 2^-PLACES. Fewer if there are fewer."""
    d = len(coefficients) - 1
    zeros = next(i for i, c in enumerate(coefficients) if c)
    scaled = [c << (PLACES * (d - i)) for i, c in enumerate(coefficients)][zeros:]
    top = -coefficients[d - 1] << PLACES if d else 0  # the trace: no root is above
    counts = {0: d - zeros, top: 0}
    roots: list[int] = []
    for k in range(1, min(most, d - zeros) + 1):
        lo = max(x for x, n in counts.items() if n >= k)
        hi = min(x for x, n in counts.items() if n < k)
        while hi - lo > 1 and not counts[lo] == k == counts[hi] + 1:
            mid = (lo + hi) // 2
            counts[mid] = _changes(scaled, mid)
            lo, hi = (mid, hi) if counts[mid] >= k else (lo, mid)
        if hi - lo > 1:  # one simple root in between: its sign tells the side
            above = _value(scaled, hi) > 0 if _value(scaled, hi) else None
            while above is not None and hi - lo > 1 and (hi - lo) << BITS > hi:
                mid = (lo + hi) // 2
                v = _value(scaled, mid)
                if v == 0:
                    lo = hi = mid
                elif (v > 0) == above:
                    hi = mid
                else:
                    lo = mid
        roots.append(hi)
    return roots


def vectors(matrix: Matrix, roots: list[int]) -> np.ndarray:
    """Unit eigenvectors (rows) for roots as largest_roots() gives them: inverse iteration in decimals, and for roots that are (nearly) one the
    vectors are made orthogonal to each other. The first entry of the greatest magnitude is positive."""
    d = len(matrix)
    size = max((abs(v) for row in matrix for v in row), default=1)
    out: list[list[Decimal]] = []
    with localcontext() as context:
        context.prec = 60 + len(str(size)) + 2 * len(str(d))
        unit = Decimal(2) ** -PLACES
        # Where a shifted pivot vanishes the root is exact; a number far below all others stands in.
        tiny = Decimal(size) * Decimal(10) ** (20 - context.prec)
        solved: dict[int, tuple] = {}
        for k, root in enumerate(roots):
            if root not in solved:
                solved = {root: _factored(matrix, Decimal(root) * unit, tiny)}
            near = [out[j] for j in range(k) if abs(roots[j] - root) << 40 < root]
            v = [Decimal((i * 7919 + k * 104729) % 1009 + 1) for i in range(d)]
            for _ in range(4):
                v = _orthogonal(_solve(solved[root], v), near)
            first = max(v, key=abs)
            out.append([x if first > 0 else -x for x in v])
        return np.array([[float(x) for x in v] for v in out]).reshape(len(roots), d)


def _factored(matrix: Matrix, shift: Decimal, tiny: Decimal) -> tuple:
    """Rows of L and U (in one) and the order of rows of matrix - shift, with the greatest pivot of each column."""
    d = len(matrix)
    a = np.array([[Decimal(v) for v in row] for row in matrix], object).reshape(d, d)
    a[np.arange(d), np.arange(d)] -= shift
    order = np.arange(d)
    for c in range(d):
        i = c + max(range(d - c), key=lambda r: abs(a[c + r, c]))
        if i != c:
            a[[c, i]], order[[c, i]] = a[[i, c]], order[[i, c]]
        if abs(a[c, c]) < tiny:
            a[c, c] = tiny
        if c + 1 < d:
            a[c + 1 :, c] /= a[c, c]
            a[c + 1 :, c + 1 :] -= np.outer(a[c + 1 :, c], a[c, c + 1 :])
    return a, order


def _solve(factored: tuple, b: list[Decimal]) -> list[Decimal]:
    a, order = factored
    d = len(order)
    x = [b[i] for i in order]
    for i in range(d):
        x[i] -= sum((a[i, j] * x[j] for j in range(i)), Decimal(0))
    for i in range(d - 1, -1, -1):
        x[i] = (x[i] - sum((a[i, j] * x[j] for j in range(i + 1, d)), Decimal(0))) / a[i, i]
    return x


def _orthogonal(v: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
    """v of length 1, without its parts along others."""
    for _ in range(2):
        norm = sum(x * x for x in v).sqrt()
        v = [x / norm for x in v]
        for o in others:
            along = sum(x * y for x, y in zip(v, o, strict=True))
            v = [x - along * y for x, y in zip(v, o, strict=True)]
    norm = sum(x * x for x in v).sqrt()
    return [x / norm for x in v]

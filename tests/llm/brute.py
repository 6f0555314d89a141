"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, percent, k):
    """{id: (set size, component)}; docs: {id: text}."""
    sets = {d: shingles(t, k) for d, t in docs.items()}
    up = {d: d for d in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def bench_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_LOW))


def benchmark_hits(text, items, width=13):
    """(n_words, n_hit, sorted ids of items found); items: [(id, text)]."""
    w, hit, found = bench_words(text), set(), set()
    for item, t in items:
        g = bench_words(t)
        n = min(width, len(g))
        if not n:
            continue
        windows = {tuple(g[i : i + n]) for i in range(len(g) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def repeated(texts, length):
    """For each text (bytes removed mask) of strings of length bytes found anywhere else."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    masks = []
    for b in raw:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i : i + length] = True
        masks.append(m)
    return masks


def _xx(*values):
    """Spark's xxhash64 of strings and bigints; None is skipped."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64(raw, seed=h % (1 << 64)).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


_ENDS = "aeiouAEIOU02468+/=._\\-\u0370-\U0010ffff"
_space = " \t\n\x0b\f\r"
_units = re.compile(rf"(?<![^{_space}])[^{_space}]{{1,20}}(?![^{_space}])|[^{_space}{_ENDS}]{{0,11}}[{_ENDS}]|[^{_space}{_ENDS}]{{1,12}}")


def order_minhash(text, k=3, l=2, m=64):  # noqa: E741
    units = _units.findall(text or "")
    n = max(len(units) - k + 1, 1) if units else 0
    kmers = [_xx(*(units[i + j] if i + j < len(units) else None for j in range(k))) for i in range(n)]
    seen, ring = Counter(), []
    for at, h in enumerate(kmers):
        e = xxhash.xxh64(seen[h].to_bytes(4, "little"), seed=_xx(h) % (1 << 64)).intdigest()
        seen[h] += 1
        ring.append((e, at, h))
    ring.sort()
    out = []
    for point in range(m if ring else 0):
        point = (point + m // 2) % m
        first = next((i for i, x in enumerate(ring) if x[0] >= point * (1 << 64) // m), 0)
        taken = [ring[(first + j) % len(ring)] for j in range(min(l, len(ring)))]
        out.append(_xx(*[h for _, h in sorted((at, h) for _, at, h in taken)]))
    return out


def likeness(a, b):
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b)) if a or b else 1.0


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


_plain = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.findall("[0-9]", m)) <= 19 and _luhn(re.findall("[0-9]", m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.findall("[0-9]", m)) <= 15),
]


def _luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    """(start, end, kind) by the base patterns, sorted."""
    return sorted((*m.span(), k) for k, (p, good) in enumerate(_plain) for m in re.finditer(p, text) if good(m[0]))


def ngrams(text):
    """The different n-grams of 1 to 3 bytes, as the numbers that langid gives them."""
    b, begin = text.lower().encode(), (0, 1 << 8, (1 << 8) + (1 << 16))
    return {begin[n - 1] + int.from_bytes(b[i : i + n], "big") for n in (1, 2, 3) for i in range(len(b) - n + 1)}

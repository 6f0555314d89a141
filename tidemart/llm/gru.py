"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation through time.

Symbols are ``heads`` frequent words in classes of ``members`` words by rank, ``forms`` classes of all other words by their
form, and the end of a text. The model gives log P(class | state) for every symbol and log P(word | class, state) for the
frequent words; words of a form class share its probability by their counts, which is left to the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    heads: int = 1024
    members: int = 32
    forms: int = 32
    hidden: int = 16

    @property
    def classes(self) -> int:
        return self.heads // self.members + self.forms + 1

    @property
    def symbols(self) -> int:
        return self.heads + self.forms + 1

    @property
    def end(self) -> int:
        return self.symbols - 1

    def parts(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {"inp": (self.symbols, 3 * h), "rec": (h, 3 * h), "cls": (h, self.classes), "cls_b": (self.classes,), "mem": (self.heads // self.members, h, self.members), "mem_b": (self.heads // self.members, self.members)}

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, s in self.parts().items():
            n = int(np.prod(s))
            out[name], at = flat[at : at + n].reshape(s), at + n
        return out


def initial(shape: Shape, counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """Random small weights; biases that give each symbol its share of counts whatever the state."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(shape.size(), np.float32)
    v = shape.views(flat)
    v["inp"][:] = rng.normal(0, 0.3, v["inp"].shape)
    v["rec"][:] = rng.normal(0, 0.5 / np.sqrt(shape.hidden), v["rec"].shape)
    v["cls"][:] = rng.normal(0, 0.05, v["cls"].shape)
    v["mem"][:] = rng.normal(0, 0.05, v["mem"].shape)
    c = counts + 0.5
    heads = c[: shape.heads].reshape(-1, shape.members)
    per_class = np.concatenate([heads.sum(1), c[shape.heads :]])
    v["cls_b"][:] = np.log(per_class / per_class.sum())
    v["mem_b"][:] = np.log(heads / heads.sum(1, keepdims=True))
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def class_of(shape: Shape, symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < shape.heads, symbols // shape.members, symbols - shape.heads + shape.heads // shape.members)


def _step(v: dict, x: np.ndarray, h: np.ndarray, hidden: int) -> tuple:
    g, a = v["inp"][x], h @ v["rec"]
    zr = _sigmoid(g[:, : 2 * hidden] + a[:, : 2 * hidden])
    z, r = zr[:, :hidden], zr[:, hidden:]
    c = np.tanh(g[:, 2 * hidden :] + r * a[:, 2 * hidden :])
    return h + z * (c - h), z, r, c, a[:, 2 * hidden :]


def _outputs(shape: Shape, v: dict, states: np.ndarray, target: np.ndarray, grad: dict | None):
    """Log probability of each row's target: log P(class) + log P(member) for frequent words; with grad, to which the weights' gradients are
    added, also d loss / d states. Rows are put in the order of their classes once, so that a class's rows are a slice."""
    cls = class_of(shape, target)
    order = np.argsort(cls, kind="stable")
    cls, target, states = cls[order], target[order], states[order]
    cuts = np.searchsorted(cls, np.arange(shape.classes + 1))
    p = states @ v["cls"]
    p += v["cls_b"]
    np.exp(p, out=p)
    total = p @ np.ones(p.shape[1], p.dtype)
    out, d_states = np.log(p[np.arange(len(cls)), cls] / total), None
    if grad is not None:
        # Of the softmax's gradient p / total - (1 at the class), both parts are taken apart: rows are scaled where they are short.
        scale = (1 / total).astype(p.dtype)
        grad["cls"] += (states * scale[:, None]).T @ p
        grad["cls_b"] += scale @ p
        d_states = p @ v["cls"].T
        d_states *= scale[:, None]
        d_states -= v["cls"].T[cls]
        here = np.flatnonzero(np.diff(cuts))
        grad["cls"][:, here] -= np.add.reduceat(states, cuts[here]).T
        grad["cls_b"][here] -= np.diff(cuts)[here]
    for c in np.flatnonzero(np.diff(cuts[: shape.heads // shape.members + 1])).tolist():
        i = slice(cuts[c], cuts[c + 1])
        s, m = states[i], target[i] - c * shape.members
        p = s @ v["mem"][c]
        p += v["mem_b"][c]
        np.exp(p, out=p)
        total, rows = p.sum(1), np.arange(len(m))
        out[i] += np.log(p[rows, m] / total)
        if grad is not None:
            p /= total[:, None]
            p[rows, m] -= 1
            grad["mem"][c] += s.T @ p
            grad["mem_b"][c] += p.sum(0)
            d_states[i] += p @ v["mem"][c].T
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back], None if d_states is None else d_states[back]


def _lanes(texts: list[np.ndarray], lanes: int, end: int):
    """Groups of texts side by side, longest first: (indices, inputs, targets, lengths); inputs begin with end, targets end with it."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for at in range(0, len(order), lanes):
        group = order[at : at + lanes]
        lengths = np.array([len(texts[i]) + 1 for i in group])
        yield group, lengths


def _window(texts: list[np.ndarray], group: list[int], lengths: np.ndarray, at: int, steps: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets (lanes x steps) of positions at to at + steps of the lanes still running; -1 past a text's end."""
    n = int(np.searchsorted(-lengths, -at, "left"))  # lanes longer than at
    x, y = np.full((n, steps), end, np.int64), np.full((n, steps), -1, np.int64)
    for k in range(n):
        t = texts[group[k]]
        part = t[at : at + steps]
        y[k, : len(part)] = part
        if at + len(part) == len(t) and len(part) < steps:
            y[k, len(part)] = end
        before = t[max(0, at - 1) : at + steps - 1]
        begin = 1 if at == 0 else 0
        x[k, begin : begin + len(before)] = before
    return x, y


def log_probabilities(shape: Shape, flat: np.ndarray, texts: list[np.ndarray], lanes: int = 1024, steps: int = 64) -> np.ndarray:
    """For each text (symbols, without end) the natural log probability of it and its end, as far as the model goes. The state is
    carried over all windows of a text."""
    v, out = shape.views(flat), np.zeros(len(texts))
    for group, lengths in _lanes(texts, lanes, shape.end):
        h = np.zeros((len(group), shape.hidden), np.float32)
        for at in range(0, int(lengths[0]), steps):
            x, y = _window(texts, group, lengths, at, steps, shape.end)
            h = h[: len(x)]
            states = np.empty((x.shape[1], len(x), shape.hidden), np.float32)
            for t in range(x.shape[1]):
                h = _step(v, x[:, t], h, shape.hidden)[0]
                states[t] = h
            t, lane = np.nonzero(y.T >= 0)
            got, _ = _outputs(shape, v, states[t, lane], y[lane, t], None)
            out[np.array(group)[: len(x)]] += np.bincount(lane, got.astype(np.float64), len(x))
    return out


def train(shape: Shape, flat: np.ndarray, batches, lanes: int = 512, steps: int = 32, rate: float = 0.02, least: int = 1024) -> tuple[np.ndarray, int]:
    """Fits by Adam on batches (lists of texts), truncating gradients at windows of steps positions while the state goes on. Windows
    are added up to a step of least positions, or to the batch's end: the few lanes of the longest texts make no steps of their own.
    Returns the new weights and the number of positions seen."""
    flat, seen, n_step = flat.copy(), 0, 0
    m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
    v, hid = shape.views(flat), shape.hidden
    g_flat, held = np.zeros_like(flat), 0
    g = shape.views(g_flat)

    def step() -> None:
        nonlocal held, n_step
        n_step += 1
        g_flat[:] /= held
        m1[:] += 0.1 * (g_flat - m1)
        m2[:] += 0.01 * (g_flat * g_flat - m2)
        flat[:] -= rate * (m1 / (1 - 0.9**n_step)) / (np.sqrt(m2 / (1 - 0.99**n_step)) + 1e-6)
        g_flat[:], held = 0, 0

    for texts in batches:
        groups = list(_lanes(texts, lanes, shape.end))
        for group, lengths in [groups[i] for i in np.random.default_rng(len(texts)).permutation(len(groups))]:
            h = np.zeros((len(group), hid), np.float32)
            for at in range(0, int(lengths[0]), steps):
                x, y = _window(texts, group, lengths, at, steps, shape.end)
                h = h[: len(x)]
                kept, hs = [], []
                for t in range(steps):
                    new, z, r, c, a = _step(v, x[:, t], h, hid)
                    kept.append((h, z, r, c, a))
                    hs.append(new)
                    h = new
                states = np.stack(hs)
                t_, lane = np.nonzero(y.T >= 0)
                _, d = _outputs(shape, v, states[t_, lane], y[lane, t_], g)
                d_states = np.zeros_like(states)
                d_states[t_, lane] = d
                dh, d_in = np.zeros_like(h), np.empty((steps, len(x), 3 * hid), np.float32)
                for t in range(steps - 1, -1, -1):
                    h0, z, r, c, a = kept[t]
                    dh = dh + d_states[t]
                    dc = dh * z * (1 - c * c)
                    d_in[t, :, :hid] = dh * (c - h0) * z * (1 - z)
                    d_in[t, :, hid : 2 * hid] = dc * a * r * (1 - r)
                    d_in[t, :, 2 * hid :] = dc
                    da = np.concatenate([d_in[t, :, : 2 * hid], dc * r], 1)
                    g["rec"] += h0.T @ da
                    dh = dh * (1 - z) + da @ v["rec"].T
                ids, rows = x.T.reshape(-1), d_in.reshape(-1, 3 * hid)
                order = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.diff(ids[order], prepend=-1))
                g["inp"][ids[order][first]] += np.add.reduceat(rows[order], first)
                seen, held = seen + len(t_), held + len(t_)
                if held >= least:
                    step()
        if held:
            step()
    return flat, seen

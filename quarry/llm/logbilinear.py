"""A log-bilinear model over a growing vocabulary, in numpy: noise-contrastive steps, and normalised log probabilities.

A context is the ``CONTEXT`` symbols before a token; its vector is h = sum_i r(w_i) C_i with a matrix for each position.
A symbol scores q(w).h + b(w).  Symbols stand by falling count in groups of neighbours: the first ones alone, later
groups the larger the rarer their symbols are, so that a token costs about the root of the vocabulary.  A group scores
like a symbol with the mean vector of its members and the log of their mass.  P(w | h) = P(group | h) P(w | group, h)
sums to 1 over all symbols, and both factors are batched products.

Noise-contrastive estimation fits the vectors: each batch tells its symbols from draws of the unigram.  Steps are
Adagrad with a rate for each row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

CONTEXT, WIDTH = 2, 24
SINGLE, GROUPS = 32, 160
NOISE, DRAWS, SHARE = 10, 32, 128
BATCH, RATE, START = 2048, 0.15, 1.0
BLOCK = 8192  # rows that are averaged together
END = b""  # no word is empty


class Symbols:
    """Words with a symbol of their own, and cells for all others by hash, by falling count; and their groups."""

    def __init__(self, words: dict[bytes, int], cell_n: np.ndarray, cell_v: np.ndarray):
        """words: count by word, the end among them; cell_n and cell_v: tokens and different tokens of each cell."""
        names = sorted(words, key=lambda w: (-words[w], w))
        n = np.concatenate((np.array([words[w] for w in names], float), cell_n.astype(float)))
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(n), np.int32)
        place[order] = np.arange(len(n), dtype=np.int32)
        self.at = dict(zip(names, place[: len(names)].tolist(), strict=True))
        self.cells = place[len(names) :]
        self.p = np.maximum(n[order], 0.5) / max(1.0, n.sum())
        self.p /= self.p.sum()
        self.own = np.zeros(len(n))  # log10 of what a cell's members share it by, less their own counts
        self.own[self.cells] = -np.log10(cell_n + cell_v + 1.0)
        size, starts, r = len(n), list(range(min(SINGLE, len(n)))), min(SINGLE, len(n))
        step = max(1e-9, 2 * (size**0.5 - r**0.5) / GROUPS)
        while r < size:
            starts.append(r)
            r += max(1, round(step * r**0.5))
        self.first = np.array([*starts, size])
        self.group = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(self.first))
        self.end = self.at[END]

    def cell(self, token: bytes) -> int:
        return int(self.cells[zlib.crc32(token) % len(self.cells)])

    def ids(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each token, and the places of those in cells."""
        get = self.at.get
        out = np.array([get(t, -1) for t in tokens], np.int32)
        away = np.flatnonzero(out < 0)
        out[away] = self.cells[np.array([zlib.crc32(tokens[i]) for i in away.tolist()], np.int64) % len(self.cells)]
        return out, away


def start(s: Symbols, width: int | None = None, context: int | None = None, seed: int = 5) -> dict[str, np.ndarray]:
    """R: context vectors, C: a matrix a position, Q: output vectors with a bias."""
    width, context, rng = width or WIDTH, context or CONTEXT, np.random.default_rng(seed)
    n = len(s.p)
    q = np.column_stack((np.zeros((n, width)), np.log(s.p)))
    c = np.concatenate([np.eye(width) / (1 + i) for i in range(context)])
    return {"R": rng.normal(0, 0.3, (n, width)).astype(np.float32), "C": c.astype(np.float32), "Q": q.astype(np.float32)}


def group_outputs(m: dict[str, np.ndarray], s: Symbols) -> np.ndarray:
    """Vectors and bias of the groups; those of a group of one are its symbol's."""
    first = s.first[:-1]
    mass = np.add.reduceat(s.p, first)
    g = np.column_stack((np.add.reduceat(m["Q"][:, :-1] * s.p[:, None], first, axis=0) / mass[:, None], np.log(mass)))
    one = np.diff(s.first) == 1
    g[one] = m["Q"][first[one]]
    return g.astype(np.float32)


def contexts(m: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the symbols before each place, nearest first, their vectors side by side, and h with a 1 for the bias."""
    k = len(m["C"]) // m["C"].shape[1]
    x = ids[at[:, None] - np.arange(1, k + 1)]
    raw = m["R"].take(x.ravel(), axis=0).reshape(len(at), -1)
    h = np.ones((len(at), m["C"].shape[1] + 1), np.float32)
    np.matmul(raw, m["C"], out=h[:, :-1])
    return x, raw, h


def _rows(ids: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the gradients of each id."""
    key = np.sort(ids.astype(np.int64) << 32 | np.arange(len(ids)))
    ids, order = key >> 32, key & ((1 << 32) - 1)
    new = np.append(True, ids[1:] != ids[:-1])
    alone = new & np.append(new[1:], True)
    ids, width = ids[new], grad.shape[1]
    out = np.empty((len(ids), width), np.float32)
    one = alone[new]
    out[one] = grad.take(order[alone], axis=0)
    if not alone.all():
        out[~one] = np.add.reduceat(grad.take(order[~alone], axis=0), np.flatnonzero(new[~alone]), axis=0)
    return ids, out


class Trainer:
    """Steps on one task's text.  ``touched`` counts, for each row, the batches that moved it."""

    def __init__(self, m: dict[str, np.ndarray], s: Symbols, seed: int, rate: float | None = None):
        self.m, self.s, self.rate, self.rng = {k: v.copy() for k, v in m.items()}, s, rate or RATE, np.random.default_rng(seed)
        self.sums = {k: np.full(len(v), START, np.float32) for k, v in m.items()}
        self.touched = {k: np.zeros(len(v), np.int32) for k, v in m.items()}
        self.cum = np.cumsum(s.p)
        self.noise = np.log(NOISE * s.p).astype(np.float32)

    def _move(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        sums = self.sums[name].take(rows)
        sums += grad[:, -1] ** 2 if name == "Q" else (grad * grad).mean(axis=1)  # the input of a bias is 1, the largest there is
        self.sums[name][rows] = sums
        grad *= (self.rate / np.sqrt(sums))[:, None]
        grad += self.m[name].take(rows, axis=0)
        self.m[name][rows] = grad
        self.touched[name][rows] += 1

    def _tell(self, h: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient of h, and rows and gradients of the outputs: observed ones against draws that ``SHARE`` tokens share."""
        q, noise = self.m["Q"], self.noise
        parts, n = -(-len(h) // SHARE), len(h)
        k = np.minimum(np.searchsorted(self.cum, self.rng.random(parts * DRAWS) * self.cum[-1]), len(q) - 1)
        own, drawn = q.take(hit, axis=0), q.take(k, axis=0).reshape(parts, DRAWS, -1)
        up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, own) - noise.take(hit), -30, 30)))
        wide = np.zeros((parts * SHARE, h.shape[1]), np.float32)
        wide[:n] = h
        wide = wide.reshape(parts, SHARE, -1)
        down = wide @ drawn.transpose(0, 2, 1)
        down -= noise.take(k).reshape(parts, 1, DRAWS)
        down *= np.float32(0.5)  # the logistic function by tanh, in place
        np.tanh(down, out=down)
        down += np.float32(1)
        down *= np.float32(-0.5 * NOISE / DRAWS)
        down.reshape(parts * SHARE, DRAWS)[n:] = 0
        own *= up[:, None]
        own += (down @ drawn).reshape(parts * SHARE, -1)[:n]
        back = down.transpose(0, 2, 1) @ wide
        rows, grad = _rows(np.concatenate((hit, k)), np.concatenate((up[:, None] * h, back.reshape(len(k), -1))))
        return own, rows, grad

    def step(self, ids: np.ndarray, at: np.ndarray) -> None:
        x, raw, h = contexts(self.m, ids, at)
        gh, rows, grad = self._tell(h, ids.take(at))
        gh = gh[:, :-1]
        back = (gh @ self.m["C"].T).reshape(-1, gh.shape[1])
        gc = raw.T @ gh
        self._move("Q", rows, grad)
        self._move("R", *_rows(x.ravel(), back))
        self._move("C", np.arange(len(gc)), gc * np.float32(0.1))

    def text(self, ids: np.ndarray, at: np.ndarray) -> None:
        for lo in range(0, len(at), BATCH):
            self.step(ids, at[lo : lo + BATCH])


def _log_softmax_at(s: np.ndarray, own: np.ndarray) -> np.ndarray:
    mine = s[np.arange(len(s)), own].astype(float)
    top = 0.0
    if len(s) and s.max() > 60:  # the exponential would overflow
        top = s.max(axis=1, keepdims=True)
        s -= top
        top = top[:, 0].astype(float)
    np.exp(s, out=s)
    return mine - top - np.log(s @ np.ones(s.shape[1], np.float32))


def log_probs(m: dict[str, np.ndarray], s: Symbols, ids: np.ndarray, at: np.ndarray, cells: int = 1 << 17) -> np.ndarray:
    """log10 P of the symbol at each place, given those before it."""
    h, y, over = contexts(m, ids, at)[2], ids[at], m["G"].T if "G" in m else group_outputs(m, s).T
    g, out = s.group[y], np.empty(len(at))
    for lo in range(0, len(at), step := max(1, cells // over.shape[1])):
        out[lo : lo + step] = _log_softmax_at(h[lo : lo + step] @ over, g[lo : lo + step])
    order = np.argsort(g.astype(np.uint16), kind="stable")  # there are a few hundred groups
    cut = np.searchsorted(g[order], np.arange(len(s.first)))
    for j in np.flatnonzero((np.diff(cut) > 0) & (np.diff(s.first) > 1)).tolist():
        a, z = s.first[j], s.first[j + 1]
        q = m["Q"][a:z].T
        for lo in range(cut[j], cut[j + 1], step := max(1, int(cells // (z - a)))):
            rows = order[lo : min(lo + step, cut[j + 1])]
            out[rows] += _log_softmax_at(h[rows] @ q, y[rows] - a)
    return out / np.log(10)


def laid_out(symbols: np.ndarray, n: np.ndarray, end: int, context: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of texts, one after the other: ends before each, its n symbols, an end; the places to predict, and each text's first."""
    context = context or CONTEXT
    count = n + 1
    first = np.cumsum(count) - count
    at = np.arange(count.sum()) + np.repeat((np.arange(len(n)) + 1) * context, count)
    ids = np.full(len(at) + context * len(n), end, np.int32)
    inner = np.ones(len(at), bool)
    inner[first + n] = False
    ids[at[inner]] = symbols
    return ids, at, first


def deltas(before: dict[str, np.ndarray], t: Trainer, block: int = BLOCK) -> Iterator[tuple[str, int, bytes, bytes, bytes]]:
    """name, block, rows (places in the block), weights, moves: what a task learnt, in blocks of rows."""
    for name, old in before.items():
        moved = np.flatnonzero(t.touched[name])
        diff = (t.m[name][moved] - old[moved]).astype("<f2")
        w = t.touched[name][moved].astype("<f4")
        cut = np.searchsorted(moved, np.arange(0, len(old) + block, block))
        for b, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if z > a:
                yield name, b, (moved[a:z] - b * block).astype("<u2").tobytes(), w[a:z].tobytes(), diff[a:z].tobytes()


def merged(parts: list[tuple[bytes, bytes, bytes]], width: int) -> tuple[bytes, bytes, bytes]:
    """Moves of one block from several tasks, averaged row by row with their weights."""
    ids = np.concatenate([np.frombuffer(p[0], "<u2") for p in parts])
    w = np.concatenate([np.frombuffer(p[1], "<f4") for p in parts]).astype(float)
    d = np.concatenate([np.frombuffer(p[2], "<f2").reshape(-1, width) for p in parts]).astype(float)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    n = np.add.reduceat(w[order], new)
    mean = np.add.reduceat(d[order] * w[order][:, None], new, axis=0) / n[:, None]
    return ids[new].tobytes(), n.astype("<f4").tobytes(), mean.astype("<f2").tobytes()

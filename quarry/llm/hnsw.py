"""Hierarchical navigable small-world graphs in numpy: searches run for many queries in step.

Vectors are unit rows.  Levels come from a hash of the place, so a graph depends on its vectors alone.  Neighbours
are chosen for spread: a candidate counts if it is nearer to the new vector than to any neighbour chosen before.
"""

from __future__ import annotations

import numpy as np

from .common import _GOLD, mix

M, M0, BUILD_BEAM, STEP = 12, 24, 40, 4


def beam(near: np.ndarray, x: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and similarities of the best ``width`` vectors found for each query, best first."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for "none"
    seen[:, -1] = True
    ids = np.full((n, width), -1, np.int64)
    sims = np.full((n, width), -np.inf, np.float32)
    e = entry.shape[1]
    ids[:, :e] = entry
    sims[:, :e] = np.where(entry >= 0, np.einsum("bkd,bd->bk", x[entry], q), -np.inf)
    seen[rows, entry] = True
    done = ids < 0
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims, done = (np.take_along_axis(a, order, 1) for a in (ids, sims, done))
    live = np.arange(n)
    while len(live):
        d = done[live]
        pick = np.argsort(d, axis=1, kind="stable")[:, :STEP]  # the best that are not expanded yet
        fresh = ~np.take_along_axis(d, pick, 1)
        r = live[:, None]
        done[r, pick] = True
        at = np.where(fresh, ids[r, pick], -1)
        new = np.where((at >= 0)[:, :, None], near[at], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[r, new]] = -1
        some = np.flatnonzero((new >= 0).any(axis=0))
        if len(some):
            new = new[:, some]
            seen[r, new] = True
            a, b = np.nonzero(new >= 0)
            s = np.full(new.shape, -np.inf, np.float32)
            hit = new[a, b]
            s[a, b] = np.einsum("kd,kd->k", x[hit], q[live[a]])
            all_s = np.concatenate((sims[live], s), axis=1)
            all_i = np.concatenate((ids[live], new), axis=1)
            all_d = np.concatenate((done[live], new < 0), axis=1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            ids[live], sims[live], done[live] = (np.take_along_axis(v, best, 1) for v in (all_i, all_s, all_d))
        live = live[~done[live].all(axis=1)]
    ids[~np.isfinite(sims)] = -1
    return ids, sims


def _spread(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of candidates, best first, up to m that lie nearer to the vector than to those chosen before; then the best of the rest."""
    n, k = cand.shape
    v = x[cand]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((n, k), bool)
    cover = np.full((n, k), -np.inf, np.float32)
    for j in range(k):
        take = (cand[:, j] >= 0) & (sims[:, j] > cover[:, j]) & (chosen.sum(axis=1) < m)
        chosen[:, j] = take
        cover = np.where(take[:, None], np.maximum(cover, between[:, :, j]), cover)
    key = np.where(cand < 0, 3, np.where(chosen, 0, 1))
    order = np.argsort(key, axis=1, kind="stable")[:, :m]
    return np.take_along_axis(np.where(cand >= 0, cand, -1), order, 1)


class Graph:
    def __init__(self, x: np.ndarray):
        """x: unit rows, float32."""
        self.x, n = np.ascontiguousarray(x, np.float32), len(x)
        u = ((mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * _GOLD) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
        self.level = np.minimum((-np.log(u) / np.log(M)).astype(np.int64), 6)
        if n:
            self.level[0] = self.level.max()
        self.near = [np.full((n, M0 if k == 0 else M), -1, np.int64) for k in range(int(self.level.max()) + 1 if n else 1)]
        at = min(n, 1)
        while at < n:
            z = min(n, at + max(1, min(256, at // 2)))
            self._insert(np.arange(at, z))
            at = z

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        entry = np.zeros((len(new), 1), np.int64)
        inner = q @ q.T
        for k in range(len(self.near) - 1, -1, -1):
            here = self.level[new] >= k
            ids, sims = beam(self.near[k], self.x, q, entry, BUILD_BEAM if here.any() else 4)
            if here.any():
                mates = np.where(here[None, :] & (np.arange(len(new))[None, :] < np.arange(len(new))[:, None]), inner, -np.inf)[here]
                best = np.argsort(-mates, axis=1, kind="stable")[:, :M]
                ms = np.take_along_axis(mates, best, 1).astype(np.float32)
                cand = np.concatenate((ids[here], np.where(np.isfinite(ms), new[best], -1)), axis=1)
                s = np.concatenate((sims[here], ms), axis=1)
                order = np.argsort(-s, axis=1, kind="stable")
                cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
                mine = _spread(self.x, cand, s, self.near[k].shape[1] // 2 if k == 0 else M // 2)
                self.near[k][new[here], : mine.shape[1]] = mine
                self._back(k, new[here], mine)
            entry = ids[:, : min(8, ids.shape[1])]

    def _back(self, k: int, new: np.ndarray, mine: np.ndarray) -> None:
        """Link back; where a vector then has too many neighbours, choose among them anew."""
        table, width = self.near[k], self.near[k].shape[1]
        a, b = np.repeat(new, mine.shape[1]), mine.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        to, first, n = np.unique(b, return_index=True, return_counts=True)
        have = (table[to] >= 0).sum(axis=1)
        fits = have + n <= width
        place = np.arange(len(b)) - np.repeat(first, n) + np.repeat(have, n)
        ok = np.repeat(fits, n)
        table[b[ok], place[ok]] = a[ok]
        for t, f, c in zip(to[~fits].tolist(), first[~fits].tolist(), n[~fits].tolist(), strict=True):
            cand = np.concatenate((table[t][table[t] >= 0], a[f : f + c]))
            s = self.x[cand] @ self.x[t]
            o = np.argsort(-s, kind="stable")
            mine = _spread(self.x, cand[o][None], s[o][None], width)[0]
            table[t] = -1
            table[t, : len(mine)] = mine

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.near) - 1, 0, -1):
            entry = beam(self.near[k], self.x, q, entry, 4)[0]
        return beam(self.near[0], self.x, q, entry, width)

    def dump(self) -> bytes:
        """The links; the vectors are not repeated."""
        return np.array([len(self.x), len(self.near)], "<i8").tobytes() + b"".join(t.astype("<i4").tobytes() for t in self.near)

    @classmethod
    def load(cls, data: bytes, x: np.ndarray) -> Graph:
        n, levels = np.frombuffer(data, "<i8", 2).tolist()
        g, at = cls.__new__(cls), 16
        g.x = np.ascontiguousarray(x, np.float32)
        g.near = []
        for k in range(levels):
            m = M if k else M0
            g.near.append(np.frombuffer(data, "<i4", n * m, at).astype(np.int64).reshape(n, m))
            at += 4 * n * m
        return g

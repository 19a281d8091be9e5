"""A robust-pruned directed graph over unit vectors: building by batches, beam search by batches.

Vectors that lie near each other are inserted, and searched for, together. The
queries of a batch share what they expand: each step takes the best open nodes
of every query, and the distances of all queries to all newly reached nodes are
one matrix product. A query thus sees at least what it would have seen alone.
"""

from __future__ import annotations

import numpy as np

DEGREE = 16
BEAM = 24
ALPHA = 1.2
EXPAND = 2
BATCH = 256
MATES = 8


class Graph:
    """Neighbours of each vector in ``links`` (-1: none). Distances are squared Euclidean, 2 - 2 cosine."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7):
        self.v = np.ascontiguousarray(vectors, np.float32)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        n = len(self.v)
        self.links = np.full((n, 2 * degree), -1, np.int32)
        self.used = np.zeros(n, np.int32)
        self.entry = int(np.argmax(self.v @ self.v.mean(axis=0))) if n else -1
        self.pivots = self._pivots(np.random.default_rng(seed))
        self._build()

    def _pivots(self, rng: np.random.Generator) -> np.ndarray:
        """About one vector a batch, picked at random, near ones next to each other."""
        n = len(self.v)
        if not n:
            return np.zeros(0, np.int64)
        some = rng.permutation(n)[: max(1, n // BATCH)]
        coarse = some[: max(1, int(len(some) ** 0.5))]
        return some[np.argsort(np.argmax(self.v[some] @ self.v[coarse].T, axis=1), kind="stable")]

    def _together(self, q: np.ndarray) -> list[np.ndarray]:
        """The rows of ``q`` in batches of neighbours."""
        near = np.concatenate([np.argmax(q[i : i + 4096] @ self.v[self.pivots].T, axis=1) for i in range(0, len(q), 4096)] or [np.zeros(0, np.int64)])
        order = np.argsort(near, kind="stable")
        return [order[i : i + BATCH] for i in range(0, len(order), BATCH)]

    def _build(self) -> None:
        if not len(self.v):
            return
        first = self.pivots[self.pivots != self.entry]
        later = np.ones(len(self.v), bool)
        later[first] = later[self.entry] = False
        at = 0
        while at < len(first):
            # what is inserted first spreads over all the vectors; batches start small
            new = first[at : at + min(BATCH, at + 1)]
            self._insert(new)
            at += len(new)
        for new in self._together(self.v):
            new = new[later[new]]
            if len(new):
                self._insert(new)

    def _insert(self, new: np.ndarray) -> None:
        ids, dist = self._walk(self.v[new], self.beam)
        if len(new) > 1:
            own = 2 - 2 * (self.v[new] @ self.v[new].T)
            np.fill_diagonal(own, np.inf)
            k = min(MATES, len(new) - 1)
            near = np.argpartition(own, k - 1, axis=1)[:, :k]
            ids = np.concatenate((ids, new[near].astype(np.int32)), axis=1)
            dist = np.concatenate((dist, np.take_along_axis(own, near, axis=1)), axis=1)
        chosen = self._prune(new, ids, dist)
        self.links[new, : self.degree] = chosen
        self.used[new] = (chosen >= 0).sum(axis=1)
        self._back(new, chosen)

    def _prune(self, points: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Up to ``degree`` of the candidates: the nearest, then each next one that no chosen one covers (alpha x closer to it than the point is)."""
        ids = np.where(ids == points[:, None], -1, ids)
        dist = np.where(ids < 0, np.inf, dist)
        order = np.argsort(dist, axis=1)
        ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
        c = self.v[np.maximum(ids, 0)]
        between = np.matmul(c, c.transpose(0, 2, 1))
        covered = between >= (1 - dist / (2 * self.alpha**2))[:, None, :]
        free = np.isfinite(dist)
        out = np.full((len(points), self.degree), -1, np.int32)
        rows = np.arange(len(points))
        for k in range(self.degree):
            pick = np.argmax(free, axis=1)
            some = free[rows, pick]
            if not some.any():
                break
            out[:, k] = np.where(some, ids[rows, pick], -1)
            free &= ~covered[rows, pick]
            free[rows, pick] = False
        return out

    def _back(self, new: np.ndarray, chosen: np.ndarray) -> None:
        """Arcs back from the chosen neighbours; lists that run over are pruned."""
        r, c = np.nonzero(chosen >= 0)
        to, frm = chosen[r, c], new[r].astype(np.int32)
        known = (self.links[to] == frm[:, None]).any(axis=1)
        to, frm = to[~known], frm[~known]
        if not len(to):
            return
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        start = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        count = np.diff(np.concatenate((start, [len(to)])))
        heads = to[start]
        room = self.links.shape[1] - self.used[heads]
        over = count > room
        place = self.used[to] + np.arange(len(to)) - np.repeat(start, count)
        fits = np.repeat(~over, count)
        self.links[to[fits], place[fits]] = frm[fits]
        self.used[heads[~over]] += count[~over]
        for h0 in range(0, int(over.sum()), BATCH):
            idx = np.flatnonzero(over)[h0 : h0 + BATCH]
            heads_ = heads[idx]
            width = int(count[idx].max())
            extra = np.full((len(idx), width), -1, np.int32)
            n = count[idx]
            rr = np.repeat(np.arange(len(idx)), n)
            cc = np.arange(len(rr)) - np.repeat(np.cumsum(n) - n, n)
            extra[rr, cc] = frm[np.repeat(start[idx], n) + cc]
            ids = np.concatenate((self.links[heads_], extra), axis=1)
            dist = 2 - 2 * np.matmul(self.v[np.maximum(ids, 0)], self.v[heads_][:, :, None])[..., 0]
            chosen_ = self._prune(heads_, ids, dist)
            self.links[heads_] = -1
            self.links[heads_, : self.degree] = chosen_
            self.used[heads_] = (chosen_ >= 0).sum(axis=1)

    def search(self, queries: np.ndarray, k: int, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest found for each query: ids (-1: none) and distances, nearest first."""
        q = np.ascontiguousarray(queries, np.float32)
        ids, dist = np.full((len(q), k), -1, np.int32), np.full((len(q), k), np.inf, np.float32)
        if not len(self.v):
            return ids, dist
        for rows in self._together(q):
            i, d = self._walk(q[rows], max(beam or self.beam, k))
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            ids[rows, : order.shape[1]] = np.take_along_axis(i, order, axis=1)
            dist[rows, : order.shape[1]] = np.take_along_axis(d, order, axis=1)
        return np.where(np.isfinite(dist), ids, -1), dist

    def _walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of one batch; ids and distances in no order."""
        n = len(self.v)
        seen, open_, mark = np.zeros(n, bool), np.ones(n, bool), np.zeros(n, bool)
        ids, dist = np.zeros((len(q), 0), np.int32), np.zeros((len(q), 0), np.float32)
        new = np.array([self.entry], np.int32)
        seen[self.entry] = True
        while True:
            if len(new):
                d = q @ self.v[new].T
                d *= -2
                d += 2
                i = np.broadcast_to(new, d.shape)
                if dist.shape[1] == beam:
                    # most of what is seen later is farther than the whole beam
                    r, c = np.divmod(np.flatnonzero((d < dist.max(axis=1)[:, None]).ravel()), len(new))
                    n_near = np.bincount(r, minlength=len(q))
                    place = np.arange(len(r)) - np.repeat(np.cumsum(n_near) - n_near, n_near)
                    near_d = np.full((len(q), n_near.max()), np.inf, np.float32)
                    near_i = np.zeros(near_d.shape, np.int32)
                    near_d[r, place], near_i[r, place] = d[r, c], new[c]
                    d, i = near_d, near_i
                dist, ids = np.concatenate((dist, d), axis=1), np.concatenate((ids, i), axis=1)
                if dist.shape[1] > beam:
                    best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                    dist, ids = np.take_along_axis(dist, best, axis=1), np.take_along_axis(ids, best, axis=1)
            todo = np.where(open_[ids], dist, np.inf)
            if todo.shape[1] > EXPAND:
                pick = np.argpartition(todo, EXPAND - 1, axis=1)[:, :EXPAND]
                todo, at = np.take_along_axis(todo, pick, axis=1), np.take_along_axis(ids, pick, axis=1)
            else:
                at = ids
            at = at[np.isfinite(todo)]
            if not len(at):
                return ids, dist
            mark[at] = True
            at = np.flatnonzero(mark)
            mark[at] = open_[at] = False
            near = self.links[at].ravel()
            near = near[near >= 0]
            mark[near[~seen[near]]] = True
            new = np.flatnonzero(mark).astype(np.int32)
            mark[new] = False
            seen[new] = True

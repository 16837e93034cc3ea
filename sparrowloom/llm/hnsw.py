"""A hierarchical navigable small-world graph over unit vectors, in numpy.

The graph of a layer is a flat array of neighbour numbers, one row per vector,
padded with -1. Vectors are inserted and searched in batches: all searches of a
batch take their steps together, so the work is in array operations.
"""

from __future__ import annotations

import numpy as np

NEG = np.float32(-9)


class Graph:
    """``x``: float32 unit vectors; ``order``: a number per vector that decides its
    layer (uniform over uint64, e.g. a hash of its id), so that the same vectors
    give the same graph."""

    def __init__(self, x: np.ndarray, order: np.ndarray, m: int = 10, ef: int = 32, batch: int = 1024):
        self.x, self.m, self.ef = np.ascontiguousarray(x, np.float32), m, ef
        n = len(x)
        sizes = [n]
        while sizes[-1] > 4 * m and len(sizes) < 12:
            sizes.append(max(1, sizes[-1] // m))
        self.perm = np.argsort(order, kind="stable")  # the first sizes[l] of these are on layer l
        self.x = self.x[self.perm]
        self.sizes, self.layers = sizes, []
        top = sizes[-1]
        links = np.full((top, 2 * m), -1, np.int32)
        if top > 1:
            s = self.x[:top] @ self.x[:top].T
            np.fill_diagonal(s, NEG)
            k = min(2 * m, top - 1)
            links[:, :k] = np.argsort(-s, axis=1, kind="stable")[:, :k]
        self.layers = [links]
        for size in reversed(sizes[:-1]):
            grown = np.full((size, 2 * m), -1, np.int32)
            grown[: len(self.layers[0])] = self.layers[0]
            self.layers.insert(0, grown)
            done = len(self.layers[1])
            while done < size:
                stop = min(size, done + min(batch, max(64, done)))
                self._insert(done, stop)
                done = stop

    def _insert(self, start: int, stop: int) -> None:
        q, m = self.x[start:stop], self.m
        found, sims = self._descend(q, self.ef, start, building=True)
        # the vectors of a batch are candidates of each other, too
        s = q @ q.T
        np.fill_diagonal(s, NEG)
        k = min(2 * m, len(q) - 1)
        if k > 0:
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            found = np.concatenate([found, near.astype(np.int32) + start], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(s, near, 1)], axis=1)
            top = np.argsort(-sims, axis=1, kind="stable")[:, : self.ef]
            found, sims = np.take_along_axis(found, top, 1), np.take_along_axis(sims, top, 1)
        kept = self._spread(found, sims, m)
        links = self.layers[0]
        links[start:stop, :m] = kept
        # links back: each end keeps its 2m best spread neighbours
        src = np.repeat(np.arange(start, stop, dtype=np.int32), m)
        dst = kept.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        w = np.einsum("nd,nd->n", self.x[src], self.x[dst])
        order = np.lexsort((-w, dst))
        src, dst, w = src[order], dst[order], w[order]
        first = np.r_[True, dst[1:] != dst[:-1]] if len(dst) else np.zeros(0, bool)
        rank = np.arange(len(dst)) - np.maximum.accumulate(np.where(first, np.arange(len(dst)), 0))
        keep = rank < 2 * m
        src, dst, w, rank = src[keep], dst[keep], w[keep], rank[keep]
        ends = dst[rank == 0]
        slot = np.cumsum(rank == 0) - 1
        have = links[ends]
        new = np.full((len(ends), 2 * m), -1, np.int32)
        new[slot, rank] = src
        free = (have >= 0).sum(1)
        need = (new >= 0).sum(1)
        fits = free + need <= 2 * m
        merged = np.concatenate([have, new], axis=1)
        # where all fit, they are only moved together; elsewhere the spread ones are chosen
        out = np.full((len(ends), 2 * m), -1, np.int32)
        if fits.any():
            rows = merged[fits]
            left = np.argsort(rows < 0, axis=1, kind="stable")[:, : 2 * m]
            out[fits] = np.take_along_axis(rows, left, 1)
        tight = ~fits
        if tight.any():
            rows = merged[tight]
            # mutual links may be listed twice
            rows = np.sort(rows, axis=1)
            rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
            s = np.einsum("nkd,nd->nk", self.x[np.maximum(rows, 0)], self.x[ends[tight]])
            s[rows < 0] = NEG
            top = np.argsort(-s, axis=1, kind="stable")
            out[tight] = self._spread(np.take_along_axis(rows, top, 1), np.take_along_axis(s, top, 1), 2 * m)
        links[ends] = out

    def _spread(self, found: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Up to ``m`` neighbours per row (candidates by falling similarity): first those that lie
        nearer to the row's vector than to any neighbour already chosen, then the nearest others."""
        b, c = found.shape
        if c <= m:
            return np.pad(np.where(sims > NEG, found, -1), ((0, 0), (0, m - c)), constant_values=-1)
        v = self.x[np.maximum(found, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        closest = np.full((b, c), NEG, np.float32)
        chosen = np.zeros((b, c), bool)
        count = np.zeros(b, np.int32)
        for j in range(c):
            good = (sims[:, j] > NEG) & (sims[:, j] > closest[:, j]) & (count < m)
            chosen[:, j] = good
            count += good
            np.maximum(closest, between[:, j], out=closest, where=good[:, None])
        rank = np.argsort(np.where(chosen, 0, np.where(sims > NEG, 1, 2)), axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(found, rank, 1).astype(np.int32)
        out[np.take_along_axis(sims, rank, 1) <= NEG] = -1
        return out

    def _descend(self, q: np.ndarray, ef: int, limit: int, building: bool = False) -> tuple[np.ndarray, np.ndarray]:
        top = min(self.sizes[-1], limit)
        s = q @ self.x[:top].T
        k = min(4, top)
        at = np.argpartition(-s, k - 1, axis=1)[:, :k].astype(np.int32)
        layers = self.layers[:-1] if len(self.layers) > 1 else self.layers
        for links in reversed(layers[1:]):
            at, _ = self._beam(q, at, links, 8)
            at = at[:, :4]
        return self._beam(q, at, layers[0], ef)

    def _beam(self, q: np.ndarray, at: np.ndarray, links: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer from the vectors ``at`` of each row (-1: none).
        Every step opens the ``wide`` best unopened candidates of each row."""
        b, n = len(q), len(links)
        ids = np.full((b, ef), -1, np.int32)
        sims = np.full((b, ef), NEG, np.float32)
        opened = np.ones((b, ef), bool)
        seen = np.zeros(b * n, np.int32)
        live = np.arange(b)
        fresh = at
        while True:
            # the cells of the step that hold a vector not seen yet; of repeated ones the last stays
            width = fresh.shape[1]
            cell = np.flatnonzero(fresh >= 0)
            f = fresh.ravel()[cell]
            r = live[cell // width]
            flat = r * n + f
            new = np.flatnonzero(seen[flat] == 0)
            cell, f, r, flat = cell[new], f[new], r[new], flat[new]
            mark = np.arange(1, len(cell) + 1, dtype=np.int32)
            seen[flat] = mark
            single = np.flatnonzero(seen[flat] == mark)
            cell, f, r = cell[single], f[single], r[single]
            near = np.full(fresh.shape, NEG, np.float32)
            near.ravel()[cell] = np.einsum("nd,nd->n", self.x.take(f, 0), q.take(r, 0))
            whole = len(live) == b
            all_s = np.concatenate([sims if whole else sims[live], near], axis=1)
            all_i = np.concatenate([ids if whole else ids[live], fresh], axis=1)
            all_o = np.concatenate([opened if whole else opened[live], near == NEG], axis=1)
            base = (np.arange(len(live)) * all_s.shape[1])[:, None]
            if all_s.shape[1] > ef:
                part = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
                order = np.argsort(-all_s.take(base + part), axis=1, kind="stable")
                order = part.take((np.arange(len(live)) * ef)[:, None] + order)
            else:
                order = np.argsort(-all_s, axis=1, kind="stable")
            order += base
            all_s, all_i, all_o = all_s.take(order), all_i.take(order), all_o.take(order)
            todo = np.argsort(all_o, axis=1, kind="stable")[:, :wide] + (np.arange(len(live)) * all_s.shape[1])[:, None]
            heads = np.where(all_o.take(todo), -1, all_i.take(todo))
            all_o.ravel()[todo] = True
            w = all_s.shape[1]
            if whole and w == ef:
                sims, ids, opened = all_s, all_i, all_o
            else:
                sims[live, :w], ids[live, :w], opened[live, :w] = all_s, all_i, all_o
            more = (heads >= 0).any(1)
            if not more.any():
                ids[sims == NEG] = -1
                return ids, sims
            live, heads = live[more], heads[more]
            fresh = np.where(heads[:, :, None] >= 0, links.take(np.maximum(heads, 0), 0), -1).reshape(len(live), -1)

    def neighbours(self, k: int, ef: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """For every vector of the graph its k most similar others: numbers (as given to the graph; -1: none) and similarities."""
        n = len(self.x)
        out, sim = np.full((n, k), -1, np.int64), np.full((n, k), NEG, np.float32)
        for a in range(0, n, block):
            own = np.arange(a, min(n, a + block), dtype=np.int32)
            ids, s = self._beam(self.x[own], own[:, None], self.layers[0], ef + 1)
            s[ids == own[:, None]] = NEG
            self._take(own, ids, s, k, out, sim)
        back_i, back_s = np.full_like(out, -1), np.full_like(sim, NEG)
        back_i[self.perm], back_s[self.perm] = np.where(out >= 0, self.perm[np.maximum(out, 0)], -1), sim
        return back_i, back_s

    def search(self, q: np.ndarray, k: int, ef: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar vectors of the graph for each row of ``q``."""
        out, sim = np.full((len(q), k), -1, np.int64), np.full((len(q), k), NEG, np.float32)
        for a in range(0, len(q), block):
            part = np.ascontiguousarray(q[a : a + block], np.float32)
            ids, s = self._descend(part, ef, len(self.x))
            self._take(np.arange(a, a + len(part)), ids, s, k, out, sim)
        return np.where(out >= 0, self.perm[np.maximum(out, 0)], -1), sim

    @staticmethod
    def _take(rows, ids, s, k, out, sim) -> None:
        s = np.where(ids >= 0, s, NEG)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        w = order.shape[1]
        best = np.take_along_axis(s, order, 1)
        out[rows, :w] = np.where(best > NEG, np.take_along_axis(ids, order, 1), -1)
        sim[rows, :w] = best

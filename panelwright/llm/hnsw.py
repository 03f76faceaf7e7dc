"""Hierarchical navigable small-world graphs in numpy: many queries walk the graph in step."""

from __future__ import annotations

import numpy as np


def _sims(v: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of each query with its own list of vectors; -2 where the id is -1."""
    got = np.matmul(v[np.maximum(ids, 0)], q[:, :, None])[:, :, 0]
    got[ids < 0] = -2.0
    return got


def _beam(v: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest found from ``start`` (query x any) on one level: ids (-1: none) and similarities, nearest first."""
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(v)), bool)
    ids = np.full((len(q), max(ef, start.shape[1])), -1, np.int64)
    ids[:, : start.shape[1]] = start
    sims = _sims(v, ids, q)
    seen[rows[:, None], np.maximum(start, 0)] |= start >= 0
    order = np.argsort(-sims, 1)[:, :ef]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    done = ids < 0
    live = rows
    while len(live):
        open_ = ~done[live]
        live = live[open_.any(1)]
        if not len(live):
            break
        at = (~done[live]).argmax(1)
        done[live, at] = True
        near = links[ids[live, at]].astype(np.int64)
        new = near >= 0
        new &= ~seen[live[:, None], np.maximum(near, 0)]
        near[~new] = -1
        i, j = np.nonzero(new)
        seen[live[i], near[i, j]] = True
        more = _sims(v, near, q[live])
        both = np.concatenate([sims[live], more], 1)
        top = np.argsort(-both, 1, kind="stable")[:, :ef]
        sims[live] = np.take_along_axis(both, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), top, 1)
    return ids, sims


def _diverse(v: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates, nearest first, none closer to a chosen one than to the row;
    room that is left goes to the nearest of the others."""
    n, k = cand.shape
    out, size = np.full((n, most), -1, np.int64), np.zeros(n, np.int64)
    taken = np.zeros((n, k), bool)
    for j in range(k):
        row = np.flatnonzero((cand[:, j] >= 0) & (size < most))
        if not len(row):
            continue
        own = _sims(v, out[row], v[cand[row, j]])
        ok = row[own.max(1) < sims[row, j]]
        out[ok, size[ok]] = cand[ok, j]
        size[ok] += 1
        taken[ok, j] = True
    for j in range(k):
        ok = np.flatnonzero((cand[:, j] >= 0) & ~taken[:, j] & (size < most))
        out[ok, size[ok]] = cand[ok, j]
        size[ok] += 1
    return out


class Hnsw:
    """A graph over unit vectors ``v`` (float32). Points are inserted in growing batches."""

    def __init__(self, v: np.ndarray, levels: np.ndarray, links: list[np.ndarray]):
        self.v, self.levels, self.links = v, levels, links
        self._back_links: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def build(cls, v: np.ndarray, m: int = 16, ef: int = 96, seed: int = 5) -> Hnsw:
        rng = np.random.default_rng(seed)
        n = len(v)
        levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 6)
        links = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(levels.max(initial=0) + 1)]
        graph, at = cls(v, levels, links), 0
        while at < n:
            size = min(max(1, at), 256, n - at)
            graph._insert(np.arange(at, at + size), m, ef)
            at += size
        return graph

    def _entry(self, below: int) -> tuple[int, int]:
        """The first point of the highest level among those before ``below``, and that level."""
        top = int(self.levels[:below].max())
        return int((self.levels[:below] == top).argmax()), top

    def _insert(self, new: np.ndarray, m: int, ef: int) -> None:
        q, first = self.v[new], int(new[0])
        entry, top = self._entry(first) if first else (-1, -1)
        at = np.full((len(new), 1), entry, np.int64)
        mates = q @ q.T
        np.fill_diagonal(mates, -2)
        for level in range(len(self.links) - 1, -1, -1):
            here = self.levels[new] >= level
            found = None
            if level <= top:
                walk = np.flatnonzero(~here)
                if len(walk):
                    at[walk] = _beam(self.v, self.links[level], q[walk], at[walk, :1], 1)[0]
                stay = np.flatnonzero(here)
                if len(stay):
                    found, sims = _beam(self.v, self.links[level], q[stay], at[stay, :1], ef)
                    at[stay, 0] = found[:, 0]
            stay = np.flatnonzero(here)
            if not len(stay):
                continue
            own = mates[np.ix_(stay, stay)]
            k = min(len(stay), ef)
            pick = np.argsort(-own, 1)[:, :k]
            cand, csim = new[stay][pick], np.take_along_axis(own, pick, 1)
            cand = np.where(csim > -2, cand, -1)
            if found is not None:
                cand, csim = np.concatenate([found, cand], 1), np.concatenate([sims, csim], 1)
                top_k = np.argsort(-csim, 1)[:, :ef]
                cand, csim = np.take_along_axis(cand, top_k, 1), np.take_along_axis(csim, top_k, 1)
            chosen = _diverse(self.v, cand, csim, m)
            self.links[level][new[stay], :m] = chosen
            self._back(level, np.repeat(new[stay], m), chosen.ravel())

    def _back(self, level: int, source: np.ndarray, target: np.ndarray) -> None:
        """Links from ``target`` back to ``source``; full lists are chosen again."""
        ok = target >= 0
        source, target = source[ok], target[ok]
        if not len(target):
            return
        sims = np.einsum("ij,ij->i", self.v[source], self.v[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        cap = self.links[level].shape[1]
        wide = min(int(counts.max()), 2 * cap)
        more = np.full((len(nodes), wide), -1, np.int64)
        place = np.arange(len(target)) - np.repeat(first, counts)
        keep = place < wide
        more[np.repeat(np.arange(len(nodes)), counts)[keep], place[keep]] = source[keep]
        # a batch mate may be there already
        old = self.links[level][nodes].astype(np.int64)
        more[(more[:, :, None] == old[:, None, :]).any(2)] = -1
        cand = np.concatenate([old, more], 1)
        s = _sims(self.v, cand, self.v[nodes])
        order = np.argsort(-s, 1)
        cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
        full = (cand >= 0).sum(1) > cap
        out = cand[:, :cap].copy()
        if full.any():
            out[full] = _diverse(self.v, cand[full], s[full], cap)
        self.links[level][nodes] = out

    def search(self, q: np.ndarray, ef: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest found for each unit query: ids (-1: none) and similarities."""
        entry, top = self._entry(len(self.v))
        ids, sims = [], []
        for a in range(0, len(q), block):
            own = q[a : a + block]
            at = np.full((len(own), 1), entry, np.int64)
            for level in range(top, 0, -1):
                at = _beam(self.v, self.links[level], own, at, 1)[0]
            i, s = _beam(self.v, self.links[0], own, at, ef)
            ids.append(i)
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)

    def _reverse(self) -> tuple[np.ndarray, np.ndarray]:
        """Who links to each point on level 0: bounds and sources."""
        if self._back_links is None:
            source, slot = np.nonzero(self.links[0] >= 0)
            target = self.links[0][source, slot]
            order = np.argsort(target, kind="stable")
            self._back_links = np.searchsorted(target[order], np.arange(len(self.v) + 1)), source[order]
        return self._back_links

    def flood(self, q: np.ndarray, start: np.ndarray, least: float) -> np.ndarray:
        """All ids at least ``least`` similar to ``q`` that links of level 0, in either direction, reach
        from ``start`` over such ids."""
        bounds, sources = self._reverse()
        seen = np.zeros(len(self.v), bool)
        seen[start] = True
        front, found = start, [start]
        while len(front):
            new = np.zeros(len(self.v), bool)
            near = self.links[0][front]
            new[near[near >= 0]] = True
            size = bounds[front + 1] - bounds[front]
            first = np.cumsum(size) - size
            new[sources[np.repeat(bounds[front] - first, size) + np.arange(size.sum())]] = True
            near = np.flatnonzero(new & ~seen)
            seen[near] = True
            front = near[self.v[near] @ q >= least]
            found.append(front)
        return np.concatenate(found)

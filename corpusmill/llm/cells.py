"""Cells of a vector space: centroids in two levels, home and probed cells, and how large cells are divided.

The centroids are put into groups of about the root of their number. A vector is compared with the groups' centres and then
only with the centroids of the groups near to it, so the work for a row grows with the root of the number of cells. Rows are
worked in slices, so memory doesn't grow with the batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

#: Rows worked at a time; cells up to which all centroids are compared; groups a vector looks into at most.
SLICE, FLAT, GROUPS = 1000, 256, 12


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _home(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def kmeans(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(sample)))
    c = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds if cells > 1 else 1):
        home = _home(sample, c)
        order = np.argsort(home, kind="stable")
        which, begin = np.unique(home[order], return_index=True)
        c[which] = np.add.reduceat(sample[order], begin, axis=0)
        empty = np.setdiff1d(np.arange(cells), which)
        if len(empty):
            c[empty] = sample[rng.choice(len(sample), len(empty))]
        c = _unit(c)
    return c.astype(np.float32)


def fit(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, begin): the centroids of group g are begin[g] to begin[g + 1]; groups get cells by their share of the sample."""
    cells = max(1, min(cells, len(sample) // 2 or 1))
    if cells <= FLAT:
        return kmeans(sample, cells), np.array([0, cells])
    top = kmeans(sample[:: max(1, len(sample) // 50_000)], int(math.sqrt(cells)))
    home = _home(sample, top)
    size = np.bincount(home, minlength=len(top))
    parts = [kmeans(sample[home == g], max(1, round(cells * size[g] / len(sample)))) for g in np.flatnonzero(size)]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


@dataclass(frozen=True)
class Cells:
    """A vector's home is its nearest cell; it asks at most ``most`` cells, those whose centroids are within ``margin`` of the nearest.

    share: of all rows, in each cell. asked: how often each cell is asked, for each row that asks. subs: into how many shards a
    cell's points are dealt.
    """

    centroids: np.ndarray
    begin: np.ndarray
    share: np.ndarray
    asked: np.ndarray
    subs: np.ndarray
    most: int
    margin: float

    @classmethod
    def of(cls, sample: np.ndarray, rows: int, cells: int, most: int, margin: float, shard: int | None = None) -> Cells:
        """For about ``rows`` rows, of which ``sample`` is one; cells of more than ``shard`` rows are dealt into several shards."""
        c, begin = fit(sample, cells)
        one = np.ones(len(c), np.int64)
        cells = cls(c, begin, one / len(c), one / len(c), one, most, margin)
        near, ok = cells.near(sample)
        share = np.bincount(near[:, 0], minlength=len(c)) / max(1, len(sample))
        asked = np.bincount(near[ok], minlength=len(c)) / max(1, len(sample))
        subs = np.maximum(1, np.ceil(share * rows / (shard or 3 * rows / len(c)))).astype(np.int64)
        return replace(cells, share=share, asked=asked, subs=subs)

    def salts(self, rows: int, queries: int) -> np.ndarray:
        """Into how many parts the queries of each cell are dealt, so that a part has about ``queries`` of them; ``rows`` vectors ask."""
        return np.maximum(1, np.ceil(self.asked * rows / queries)).astype(np.int64)

    def _nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest cells and their similarities, in no order."""
        if len(self.begin) == 2:
            s = x @ self.centroids.T
            near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            return near, np.take_along_axis(s, near, 1)
        sizes = np.diff(self.begin)
        heads = _unit(np.add.reduceat(self.centroids, self.begin[:-1], axis=0))
        g = heads @ x.T
        look = min(GROUPS, len(heads))
        chosen = np.argpartition(-g, look - 1, axis=0)[:look].T if look < len(heads) else np.broadcast_to(np.arange(look), (len(x), look))
        wide = int(min(k, sizes.max()))
        ids, sims = np.zeros((len(x), look * wide), np.int64), np.full((len(x), look * wide), -np.inf, np.float32)
        row, place = np.divmod(np.argsort(chosen.ravel(), kind="stable"), look)
        edges = np.flatnonzero(np.diff(chosen[row, place], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:]):
            r, p = row[lo:hi], place[lo:hi]
            one = chosen[r[0], p[0]]
            s = x[r] @ self.centroids[self.begin[one] : self.begin[one + 1]].T
            n = min(wide, s.shape[1])
            best = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.broadcast_to(np.arange(n), s.shape)
            at = p[:, None] * wide + np.arange(n)
            ids[r[:, None], at], sims[r[:, None], at] = best + self.begin[one], np.take_along_axis(s, best, 1)
        if sims.shape[1] > k:
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        return ids, sims

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, ok): the nearest cells of each vector, nearest first, and which of them are to be probed."""
        k = min(self.most, len(self.centroids))
        ids, sims = np.zeros((len(x), k), np.int64), np.full((len(x), k), -np.inf, np.float32)
        for at in range(0, len(x), SLICE):
            i, s = self._nearest(x[at : at + SLICE], k)
            order = np.argsort(-s, axis=1, kind="stable")
            ids[at : at + SLICE, : i.shape[1]], sims[at : at + SLICE, : i.shape[1]] = np.take_along_axis(i, order, 1), np.take_along_axis(s, order, 1)
        ok = sims >= sims[:, :1] - self.margin
        ok[:, 0] = True
        return ids, ok & np.isfinite(sims)

    def deal(self, ids: np.ndarray, x: np.ndarray, salts: np.ndarray, index: bool = True, ask: bool = True):
        """(row, cell, sub, salt, indexed, asked) of every copy of a row that a shard needs: in its own shard, once for each part of
        that cell's queries, and in every shard it asks, among the part of the queries it is dealt to."""
        near, ok = self.near(x)
        h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        g = (ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)
        out = []
        for j in range(near.shape[1]):
            cell = near[:, j]
            parts, shards = salts[cell], self.subs[cell]
            own_sub, own_salt = (h % shards.astype(np.uint64)).astype(np.int64), (g % parts.astype(np.uint64)).astype(np.int64)
            if j == 0 and index:
                r, salt = _repeated(parts)
                out.append((r, cell[r], own_sub[r], salt, np.ones(len(r), bool), (salt == own_salt[r]) & ask))
            if ask:
                r, sub = _repeated(np.where(ok[:, j], shards, 0))
                if j == 0 and index:  # the indexed copy asks its own shard
                    other = sub != own_sub[r]
                    r, sub = r[other], sub[other]
                out.append((r, cell[r], sub, own_salt[r], np.zeros(len(r), bool), np.ones(len(r), bool)))
        return tuple(np.concatenate(c) for c in zip(*out))


def _repeated(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as told, with a number from 0."""
    r = np.repeat(np.arange(len(times)), times)
    return r, np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)

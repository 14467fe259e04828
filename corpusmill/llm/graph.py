"""Neighbourhood graphs over unit vectors, worked in batches with NumPy: greedy beam search, insertion, pruning.

A graph is a matrix of neighbour numbers, -1 where there is none. Points are inserted in batches of doubling size: every
point of a batch searches the graph as it is, chooses its neighbours among what the search came by, and is then made a
neighbour of theirs.

Queries near to each other search together: they are dealt into blocks by the entry point nearest to them; a point that one
of a block expands has its neighbours compared with all of the block by one matrix product. Each query keeps a beam of its
own and ends when all of it is expanded.
"""

from __future__ import annotations

import ctypes
import re
from functools import lru_cache

import numpy as np

#: Points inserted at a time, and rows of a large intermediate matrix.
BATCH, STEP = 2048, 512
#: Queries of one block.
BLOCK = 128


@lru_cache
def one_thread() -> None:
    """Has this process work matrix products in one thread: they are small here, so more threads would only wait for each other
    while the cores have other tasks. Where NumPy's library isn't known, nothing is done."""
    try:
        with open("/proc/self/maps", encoding="utf-8") as maps:
            paths = set(re.findall(r"\S*openblas\S*\.so\S*", maps.read()))
    except OSError:
        return
    for path in paths:
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if setter := getattr(ctypes.CDLL(path), name, None):
                setter(1)
                break


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, width: int, entries: np.ndarray, expand: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best points met from the entries on, with their similarities, best first (-1 and -inf behind the last).

    In every step the ``expand`` best points not yet expanded are, until none is left among the best ``width``.
    """
    one_thread()
    out_i = np.full((len(queries), width), -1, np.int32)
    out_s = np.full((len(queries), width), -np.inf, np.float32)
    if not len(x):
        return out_i, out_s
    near = x[entries]
    for at in range(0, len(queries), 8 * BATCH):
        q = queries[at : at + 8 * BATCH]
        first = q @ near.T
        some = min(4, len(entries))
        start = np.argpartition(-first, some - 1, axis=1)[:, :some]
        order = np.argsort(first.argmax(1), kind="stable")
        for lo in range(0, len(q), BLOCK):
            rows = order[lo : lo + BLOCK]
            i, s = _search(x, graph, q[rows], width, entries[np.unique(start[rows])], expand)
            out_i[at + rows, : i.shape[1]], out_s[at + rows, : i.shape[1]] = i, s
    return out_i, out_s


def _best(ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    if sims.shape[1] <= width:
        return ids, sims
    best = np.argpartition(sims, sims.shape[1] - width, axis=1)[:, -width:]
    return np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)


def _search(x, graph, q, width, entries, expand):
    seen = np.zeros(len(x) + 1, bool)  # the last one stands for no neighbour
    done = np.zeros(len(x), bool)
    seen[-1] = seen[entries] = True
    sims = q @ x[entries].T
    ids, sims = _best(np.broadcast_to(entries.astype(np.int32), sims.shape), sims, width)
    while True:
        open_ = np.where(done[ids], np.float32(-np.inf), sims)
        if expand < ids.shape[1]:
            pick = np.argpartition(open_, ids.shape[1] - expand, axis=1)[:, -expand:]
            chosen = np.take_along_axis(ids, pick, 1)[np.take_along_axis(open_, pick, 1) > -np.inf]
        else:
            chosen = ids[open_ > -np.inf]
        if not len(chosen):
            break
        done[chosen] = True
        new = graph[np.unique(chosen)].ravel()
        new = new[~seen[new]]
        if not len(new):
            continue
        new = np.unique(new)
        seen[new] = True
        s = q @ x[new].T
        if ids.shape[1] == width:
            use = (s > sims.min(1)[:, None]).any(0)
            new, s = new[use], s[:, use]
        ids, sims = _best(np.concatenate([ids, np.broadcast_to(new, s.shape)], 1), np.concatenate([sims, s], 1), width)
    order = np.argsort(-sims, axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def robust_prune(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of candidates sorted best first, keeps the nearest, drops all that are alpha times nearer to it than to the point, and so on."""
    m, k = cand.shape
    v = x[np.maximum(cand, 0)]
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    to_point = 2 - 2 * sims
    alive = cand >= 0
    out = np.full((m, degree), -1, np.int32)
    rows = np.arange(m)
    square = np.float32(alpha * alpha)
    for j in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, j] = cand[rows[some], first[some]]
        alive[rows, first] = False
        alive &= (square * between[rows, first] > to_point) | ~some[:, None]
    return out


def nearest(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The nearest candidates, without pruning (a plain navigable small world)."""
    out = np.full((len(cand), degree), -1, np.int32)
    out[:, : min(degree, cand.shape[1])] = cand[:, :degree]
    return out


def entry_points(n: int, each: int = 64) -> np.ndarray:
    """A point of every ``each``; as points lie in random order, these lie in all regions."""
    return np.arange(0, n, each, dtype=np.int32)


def build(x: np.ndarray, degree: int = 24, width: int = 32, alpha: float = 1.02, choose=robust_prune, forward: int | None = None, met: list | None = None) -> np.ndarray:
    """The graph of the points in the given order (which should be random); ``forward`` neighbours are chosen at insertion.

    ``met`` gets (points, neighbours found, similarities) of every insertion.
    """
    one_thread()
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    if n < 2:
        return graph
    forward = forward or degree
    first = min(n, max(64, width))
    s = x[:first] @ x[:first].T
    np.fill_diagonal(s, -np.inf)
    order = np.argsort(-s, axis=1)[:, : min(first - 1, width)].astype(np.int32)
    graph[:first] = choose(x, order, np.take_along_axis(s, order, 1), degree, alpha)
    if met is not None:
        met.append((np.arange(first), order, np.take_along_axis(s, order, 1)))
    at = first
    while at < n:
        end = min(n, 2 * at, at + BATCH)
        batch = np.arange(at, end)
        ids, sims = beam_search(x, graph[:at], x[batch], width, entry_points(at))
        ids, sims = _with_own(x, batch, ids, sims)
        if met is not None:
            met.append((batch, ids, sims))
        chosen = choose(x, ids, sims, forward, alpha)
        graph[batch, :forward] = chosen
        _link_back(x, graph, batch, chosen, alpha, choose)
        at = end
    return graph


def _with_own(x, batch, ids, sims, many: int = 8):
    """Candidates with the nearest of the same batch, which the graph doesn't hold yet."""
    k = min(many, len(batch) - 1)
    if k < 1:
        return ids, sims
    own_i, own_s = np.empty((len(batch), k), np.int32), np.empty((len(batch), k), np.float32)
    for lo in range(0, len(batch), STEP):
        own = x[batch[lo : lo + STEP]] @ x[batch].T
        own[np.arange(len(own)), lo + np.arange(len(own))] = -np.inf
        near = np.argpartition(-own, k - 1, axis=1)[:, :k]
        own_i[lo : lo + STEP], own_s[lo : lo + STEP] = batch[near], np.take_along_axis(own, near, 1)
    ids, sims = np.concatenate([ids, own_i], 1), np.concatenate([sims, own_s], 1)
    order = np.argsort(-sims, axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _link_back(x, graph, batch, chosen, alpha, choose) -> None:
    degree = graph.shape[1]
    r, c = np.nonzero(chosen >= 0)
    target, source = chosen[r, c], batch[r].astype(np.int32)
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    points, begin, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(points), STEP):
        p, b, k = points[lo : lo + STEP], begin[lo : lo + STEP], count[lo : lo + STEP]
        most = int(k.max())
        cand = np.full((len(p), degree + most), -1, np.int32)
        cand[:, :degree] = graph[p]
        rows = np.repeat(np.arange(len(p)), k)
        offset = np.arange(len(rows)) - np.repeat(np.cumsum(k) - k, k)
        cand[rows, degree + offset] = source[np.repeat(b, k) + offset]
        have = (cand >= 0).sum(1)
        sims = np.where(cand >= 0, np.matmul(x[np.maximum(cand, 0)], x[p][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
        best = np.argsort(-sims, axis=1)
        cand, sims = np.take_along_axis(cand, best, 1), np.take_along_axis(sims, best, 1)
        over = have > degree
        graph[p[~over]] = cand[~over, :degree]
        if over.any():
            keep = min(cand.shape[1], 2 * degree)
            graph[p[over]] = choose(x, cand[over, :keep], sims[over, :keep], degree, alpha)

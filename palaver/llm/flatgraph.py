"""A robust-pruned flat graph over some vectors, and greedy search with range expansion, for many queries at once.

Edges point to near vectors in different directions (Subramanya et al. 2019): of the candidates in
descending order of cosine those stay that no chosen one is closer to.  Half of a vector's edges are
chosen strictly, so that a vector amid very many near ones keeps edges that lead away from them; the
others leniently, so that near ones stay connected.  All steps work on arrays of queries; nothing is
done query by query.
"""

from __future__ import annotations

import numpy as np

from palaver.llm.common import ranges

#: Edges of a vector, new candidates for edges back, and the factors of distance of the two prunings.
DEGREE, CANDIDATES, STRICT, LENIENT = 20, 20, 1.2, 0.8
#: Edges of a place that a greedy walk looks at, and the first places of a walk that are candidates for edges.
WIDTH, WALKED = 40, 16
#: Places below the range by so much are expanded as well.
SLACK = 0.02
#: Places that a greedy search keeps.
BEAM = 32
#: Queries that are searched, and found places that are expanded, at once.
QUERIES, EXPANDED = 512, 50_000


def cosines(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of a and rows j of b, in steps of bounded memory."""
    out = np.empty(len(i))
    for at in range(0, len(i), EXPANDED):
        s = slice(at, at + EXPANDED)
        out[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]])
    return out


def robust_prune(own: np.ndarray, candidates: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each of ``own`` up to DEGREE of its candidates (a row of places; -1: none), padded with -1."""
    n, width = candidates.shape
    chosen = np.full((n, DEGREE), -1, dtype=np.int64)
    for at in range(0, n, QUERIES):
        mine, rows = own[at : at + QUERIES], candidates[at : at + QUERIES]
        there = vectors[rows]
        sims = np.einsum("nd,ncd->nc", vectors[mine], there)
        sims[(rows < 0) | (rows == mine[:, None])] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")
        rows, sims, there = np.take_along_axis(rows, order, 1), np.take_along_axis(sims, order, 1), np.take_along_axis(there, order[:, :, None], 1)
        gram = there @ there.transpose(0, 2, 1)
        left, taken = np.isfinite(sims), np.zeros(len(rows), dtype=np.int64)
        left[:, 1:] &= rows[:, 1:] != rows[:, :-1]  # equal places have equal cosines
        for factor, most in ((STRICT, DEGREE // 2), (LENIENT, DEGREE)):
            alive = left.copy()
            for c in range(width):
                new = np.flatnonzero(alive[:, c] & (taken < most))
                if len(new):
                    chosen[at + new, taken[new]] = rows[new, c]
                    taken[new] += 1
                    left[new, c] = False
                    alive[new] &= 1 - gram[new, c] > factor * (1 - sims[new])
    return chosen


def greedy(queries: np.ndarray, edges: np.ndarray, vectors: np.ndarray, entry: int, slack: float = np.inf):
    """What greedy walks from ``entry`` meet: the best places and the first ones expanded (queries x places, padded
    with -1), whether each place was met, and what was met at cosines of ``slack`` or more, as (query, place, cosine)."""
    m, width, beam = len(queries), edges.shape[1], BEAM
    met = np.zeros((m, len(vectors)), dtype=bool)
    places, sims, done = np.full((m, beam), -1, dtype=np.int64), np.full((m, beam), -np.inf), np.zeros((m, beam), dtype=bool)
    places[:, 0], sims[:, 0], met[:, entry] = entry, queries @ vectors[entry], True
    near = np.flatnonzero(sims[:, 0] >= slack)
    hits = [(near, np.full(len(near), entry), sims[near, 0])]
    rows, walked = np.arange(m), []
    while True:
        open_ = np.where(done[rows], -np.inf, sims[rows])
        best = open_.argmax(axis=1)
        going = open_[np.arange(len(rows)), best] > -np.inf
        rows, best = rows[going], best[going]
        if not len(rows):
            return places, np.stack(walked, axis=1), met, [np.concatenate([h[k] for h in hits]) for k in range(3)]
        done[rows, best] = True
        if len(walked) < WALKED:
            step = np.full(m, -1, dtype=np.int64)
            step[rows] = places[rows, best]
            walked.append(step)
        near = edges[places[rows, best]]
        row, column = np.nonzero((near >= 0) & ~met[rows[:, None], near])
        met[rows[row], near[row, column]] = True
        found = np.full((len(rows), width), -np.inf)
        found[row, column] = cosine = cosines(queries, rows[row], vectors, near[row, column])
        close = cosine >= slack
        hits.append((rows[row[close]], near[row[close], column[close]], cosine[close]))
        every = np.concatenate([sims[rows], found], axis=1)
        top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        sims[rows] = np.take_along_axis(every, top, 1)
        places[rows] = np.take_along_axis(np.concatenate([places[rows], near], axis=1), top, 1)
        places[rows] = np.where(sims[rows] > -np.inf, places[rows], -1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(near.shape, dtype=bool)], axis=1), top, 1)


def medoid(vectors: np.ndarray) -> int:
    return int((vectors @ vectors.mean(axis=0)).argmax())


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each vector, out of it and then back along those into it: their places, and where each vector's end.

    Vectors are inserted in small batches, and all once more along edges in both directions: each
    is searched for from the medoid, what the walk and its best places are is pruned to its edges,
    and those get an edge back, pruned again where they have too many.
    """
    n = len(vectors)
    edges = np.full((n, DEGREE), -1, dtype=np.int64)
    start = medoid(vectors)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    cuts, size = [1], 1
    while cuts[-1] < n:
        size = min(2 * size, max(64, n // 8))
        cuts.append(min(n, cuts[-1] + size))
    for first in (True, False):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True) if first else [(at, min(n, at + QUERIES)) for at in range(0, n, QUERIES)]:
            own = order[a:b]
            walks = edges if first else padded(*both_ways(edges))
            places, walked, _, _ = greedy(vectors[own], walks, vectors, start)
            edges[own] = robust_prune(own, np.concatenate([places, walked, edges[own]], axis=1), vectors)
            _edges_back(own, edges, vectors)
    return both_ways(edges)


def both_ways(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded edges as lists, each neighbour once, with those into a vector after those out of it."""
    source, column = np.nonzero(edges >= 0)
    target = edges[source, column]
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    once = np.sort(np.unique(a * len(edges) + b, return_index=True)[1])
    a, b = a[once], b[once]
    order = np.argsort(a, kind="stable")
    return b[order], np.searchsorted(a[order], np.arange(len(edges)), side="right")


def _edges_back(own: np.ndarray, edges: np.ndarray, vectors: np.ndarray) -> None:
    row, column = np.nonzero(edges[own] >= 0)
    source, target = own[row], edges[own][row, column]
    known = (edges[target] == source[:, None]).any(axis=1)
    source, target = source[~known], target[~known]
    if not len(source):
        return
    # of many new ones the nearest are candidates
    order = np.lexsort((-cosines(vectors, source, vectors, target), target))
    source, target = source[order], target[order]
    ends, first, count = np.unique(target, return_index=True, return_counts=True)
    nth = np.arange(len(target)) - np.repeat(first, count)
    near = nth < CANDIDATES
    new = np.full((len(ends), CANDIDATES), -1, dtype=np.int64)
    new[np.repeat(np.arange(len(ends)), count)[near], nth[near]] = source[near]
    free = (edges[ends] < 0).sum(axis=1)
    room = count <= free
    for k in range(DEGREE):  # where all fit they are appended
        add = np.flatnonzero(room & (k < count))
        edges[ends[add], DEGREE - free[add] + k] = new[add, k]
    full = np.flatnonzero(~room)
    edges[ends[full]] = robust_prune(ends[full], np.concatenate([edges[ends[full]], new[full]], axis=1), vectors)


def padded(flat: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The first ``width`` edges of each vector, padded with -1."""
    counts = np.minimum(np.diff(ends, prepend=0), width)
    out = np.full((len(ends), width), -1, dtype=np.int64)
    row = np.repeat(np.arange(len(ends)), counts)
    column = ranges(np.zeros(len(ends), dtype=np.int64), counts)
    out[row, column] = flat[np.repeat(np.concatenate([[0], ends[:-1]]), counts) + column]
    return out


def in_range(queries: np.ndarray, graph: tuple[np.ndarray, np.ndarray], vectors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, place) with a cosine of at least ``least``.

    A greedy search from the medoid leads to the query's surroundings; from then on everything
    found in range (with a little slack) is expanded until no new place in range is met.
    """
    entry, slack, n = medoid(vectors), least - SLACK, len(vectors)
    flat, ends = graph
    edges = padded(flat, ends)
    begins, counts = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
    out = [(np.zeros(0, dtype=np.int64),) * 2]
    for at in range(0, len(queries), QUERIES):
        part = queries[at : at + QUERIES]
        _, _, met, (q, place, cosine) = greedy(part, edges, vectors, entry, slack)
        met, last = met.ravel(), np.zeros(len(part) * n, dtype=np.int64)
        while len(q):
            sure = cosine >= least
            out.append((q[sure] + at, place[sure]))
            more = []
            for s in range(0, len(q), EXPANDED):
                many = counts[place[s : s + EXPANDED]]
                key = np.repeat(q[s : s + EXPANDED] * n, many) + flat[ranges(begins[place[s : s + EXPANDED]], many)]
                key = key[~met[key]]
                last[key] = np.arange(len(key))
                key = key[last[key] == np.arange(len(key))]  # each once
                met[key] = True
                c = cosines(part, key // n, vectors, key % n)
                more.append((key[c >= slack], c[c >= slack]))
            q, place, cosine = np.concatenate([x[0] // n for x in more]), np.concatenate([x[0] % n for x in more]), np.concatenate([x[1] for x in more])
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

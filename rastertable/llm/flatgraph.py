"""A robust-pruned flat graph (one layer) over unit vectors, in NumPy, for one cluster shard at a time."""

from __future__ import annotations

import numpy as np

NONE = -1


def _top(ids: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best different ids of each row by similarity; ids, similarities and the order that gave them."""
    order = np.lexsort((-sims, ids), axis=1)
    rows = np.arange(len(ids))[:, None]
    again = ids[rows, order]
    repeat = np.zeros_like(again, bool)
    repeat[:, 1:] = again[:, 1:] == again[:, :-1]
    masked = np.where(repeat | (again == NONE), -np.inf, sims[rows, order])
    best = np.argsort(-masked, axis=1, kind="stable")[:, :keep]
    chosen = np.take_along_axis(order, best, 1)
    sims = np.take_along_axis(masked, best, 1)
    return np.where(np.isfinite(sims), ids[rows, chosen], NONE), sims, chosen


def greedy(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, greedy search from ``starts``: the nodes of its final beam and their similarities, all queries side by side. It
    ends when all nodes of all beams have been looked at; a node that left a beam is too far to come back."""
    n = len(queries)
    ids = np.tile(starts[None, :], (n, 1))
    sims = queries @ x[starts].T
    done = np.zeros_like(ids, bool)
    while True:
        open_ = np.where(done | (ids == NONE), -np.inf, sims)
        pick = open_.argmax(1)
        live = np.isfinite(open_[np.arange(n), pick])
        if not live.any():
            break
        rows = np.flatnonzero(live)
        done[rows, pick[rows]] = True
        near = edges[ids[rows, pick[rows]]]
        fresh = np.where(near == NONE, -np.inf, np.einsum("qrd,qd->qr", x[near], queries[rows]))
        all_ids = np.concatenate([ids[rows], near], 1)
        all_sims = np.concatenate([sims[rows], fresh], 1)
        # a node met again keeps the mark of the place that it has
        all_done = np.concatenate([done[rows], np.zeros_like(near, bool)], 1)
        kept, s, chosen = _top(all_ids, all_sims - 1e-9 * ~all_done, min(beam, all_ids.shape[1]))
        s = np.where(kept == NONE, -np.inf, np.take_along_axis(all_sims, chosen, 1))
        if kept.shape[1] > ids.shape[1]:
            pad = kept.shape[1] - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=NONE)
            sims, done = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf), np.pad(done, ((0, 0), (0, pad)))
        ids[rows], sims[rows], done[rows] = kept, s, np.take_along_axis(all_done, chosen, 1)
    return ids, sims


def prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: again and again the nearest candidate stays, and those that are ``alpha`` times nearer to it than to the point go."""
    candidates = np.where(candidates == points[:, None], NONE, candidates)
    sims = np.where(candidates == NONE, -np.inf, np.einsum("pcd,pd->pc", x[candidates], x[points]))
    candidates, sims, _ = _top(candidates, sims, candidates.shape[1])
    far = np.where(candidates == NONE, np.inf, np.sqrt(np.maximum(0, 2 - 2 * np.where(candidates == NONE, 1, sims))))
    own = x[candidates]
    out = np.full((len(points), degree), NONE, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        pick = far.argmin(1)
        live = np.isfinite(far[rows, pick])
        if not live.any():
            break
        out[live, k] = candidates[rows, pick][live]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("pcd,pd->pc", own, own[rows, pick])))
        far[(alpha * between <= far) | (candidates == out[:, k, None])] = np.inf
        far[~live] = np.inf
    return out


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(0)))


def build(x: np.ndarray, degree: int = 16, beam: int = 24, alpha: float = 1.2, seed: int = 0) -> np.ndarray:
    """Out-neighbours of each vector (rows padded with -1). Vectors come in random order in batches that double; each batch searches the
    graph so far from the medoid, is pruned, and its edges are added in reverse."""
    n = len(x)
    edges = np.full((n, degree), NONE, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    start = medoid(x) if n else 0
    order = np.concatenate([[start], order[order != start]]).astype(np.int64)
    at = 1
    while at < n:
        batch = order[at:at + min(at, 1024)]
        found, _ = greedy(x, edges, x[batch], np.array([start]), beam)
        # points of one batch do not see each other in the graph yet; a few of them are candidates too
        peers = batch[(np.arange(len(batch))[:, None] + np.arange(1, 1 + min(8, len(batch)))) % len(batch)]
        edges[batch] = prune(x, batch, np.concatenate([found, peers], 1), degree, alpha)
        _add(x, edges, np.repeat(batch, degree), edges[batch].ravel(), degree, alpha)
        at += len(batch)
    return edges


def _add(x: np.ndarray, edges: np.ndarray, sources: np.ndarray, targets: np.ndarray, degree: int, alpha: float) -> None:
    """Reverse edges; a list that grows too long is pruned, in portions where very many come at once."""
    ok = targets != NONE
    sources, targets = sources[ok], targets[ok]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    nth = np.arange(len(targets)) - np.searchsorted(targets, targets)
    for wave in range(0, int(nth.max()) // degree + 1 if len(nth) else 0):
        use = nth // degree == wave
        nodes, row = np.unique(targets[use], return_inverse=True)
        more = np.full((len(nodes), degree), NONE, np.int64)
        more[row, nth[use] % degree] = sources[use]
        every = np.concatenate([edges[nodes], more], 1)
        full = (every != NONE).sum(1) > degree
        if full.any():
            edges[nodes[full]] = prune(x, nodes[full], every[full], degree, alpha)
        rest = every[~full]
        edges[nodes[~full]] = np.take_along_axis(rest, np.argsort(rest == NONE, axis=1, kind="stable"), 1)[:, :degree]


def in_range(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, places: np.ndarray, starts: np.ndarray, least: float, slack: float = 0.05,
             beam: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) for all nodes found with similarity of at least ``least``. ``queries`` are vectors; ``places`` are the nodes that
    they are, or NONE.

    Greedy search from the starts, and the query's own place, gives the first nodes; from then on the neighbours of every node
    within the range (and a little beyond) are looked at, along edges in either direction, until no new one is.
    """
    n = len(x)
    seen = np.zeros((len(queries), n), bool)
    ids, sims = greedy(x, edges, queries, starts, beam)
    row, col = np.nonzero((ids != NONE) & (sims >= least - slack))
    placed = np.flatnonzero(places != NONE)
    q = np.concatenate([placed, row])
    node = np.concatenate([places[placed], ids[row, col]])
    first, near = neighbours(edges)
    found_q, found_n = [], []
    while len(q):
        key = np.unique(q * n + node)
        q, node = key // n, key % n
        seen[q, node] = True
        s = np.empty(len(q))
        for a in range(0, len(q), 1 << 17):
            part = slice(a, a + (1 << 17))
            s[part] = np.einsum("kd,kd->k", queries[q[part]], x[node[part]])
        hit = s >= least
        found_q.append(q[hit])
        found_n.append(node[hit])
        go = s >= least - slack
        go_q, go_node, more_q, more_n = q[go], node[go], [], []
        for a in range(0, len(go_q), 1 << 14):
            own_q, own = go_q[a:a + (1 << 14)], go_node[a:a + (1 << 14)]
            count = first[own + 1] - first[own]
            own_q = np.repeat(own_q, count)
            own = near[np.repeat(first[own] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            new = ~seen[own_q, own]
            more = np.unique(own_q[new] * n + own[new])
            more_q.append(more // n)
            more_n.append(more % n)
        q, node = (np.concatenate(m) if m else np.zeros(0, np.int64) for m in (more_q, more_n))
    q, node = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (found_q, found_n))
    other = places[q] != node
    return q[other], node[other]


def neighbours(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges in both directions: of each node, where its neighbours begin (one more at the end), and all neighbours."""
    n = len(edges)
    a, col = np.nonzero(edges != NONE)
    b = edges[a, col]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.searchsorted(pairs // max(1, n), np.arange(n + 1)), pairs % max(1, n)

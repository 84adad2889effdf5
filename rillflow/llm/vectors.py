"""A robust-pruned flat graph over vectors, in numpy: building, greedy search, range expansion."""

from __future__ import annotations

import numpy as np

#: Pairs whose vectors are gathered at once.
PAIRS = 100_000
#: Share of all pairs of a block of queries and a graph from which on they are scored at once instead of one after the other.
DENSE = 0.02


def cosines(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of the rows a of x and b of y, some at a time."""
    return np.concatenate([np.zeros(0), *(np.einsum("kd,kd->k", x[a[k : k + PAIRS]], y[b[k : k + PAIRS]]) for k in range(0, len(a), PAIRS))])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that the squares of no finite row overflow or vanish."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0.0), np.finfo(np.float64).tiny)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pruned(x: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each node's pool of candidates (-1: none) to ``degree`` neighbours.

    The nearest candidate is taken again and again; it rules out those that are nearer to it, by the factor alpha, than
    to the node. All nodes take their k-th neighbour at once.
    """
    n, width = pool.shape
    held = x[np.maximum(pool, 0)]
    far = np.maximum(0.0, 2 - 2 * np.einsum("nwd,nd->nw", held, x[own]))
    far[(pool < 0) | (pool == own[:, None])] = np.inf
    out = np.full((n, degree), -1, dtype=np.int64)
    rows = np.arange(n)
    for k in range(degree):
        best = far.argmin(axis=1)
        some = np.isfinite(far[rows, best])
        out[some, k] = pool[rows[some], best[some]]
        chosen = held[rows, best]
        between = np.maximum(0.0, 2 - 2 * np.einsum("nwd,nd->nw", held, chosen))
        far[(alpha * alpha * between <= far) & some[:, None] & np.isfinite(far)] = np.inf
        far[rows, best] = np.inf
    return out


def build(x: np.ndarray, degree: int, seed: int, alpha: float = 1.2, near: int = 48, wide: int = 16, rows: int = 256) -> np.ndarray:
    """Neighbours of each of the unit vectors: pruned near ones, their reverses, and pruned ones from anywhere."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near = min(near, n)
    edges = np.full((n, degree), -1, dtype=np.int64)
    far_degree = degree // 4
    for at in range(0, n, rows):
        own = np.arange(at, min(n, at + rows))
        close = x[own] @ x.T
        pool = np.argpartition(-close, near - 1, axis=1)[:, :near] if near < n else np.tile(np.arange(n), (len(own), 1))
        edges[own, : degree - far_degree] = pruned(x, own, pool, degree - far_degree, alpha)
        edges[own, degree - far_degree :] = pruned(x, own, rng.integers(0, n, (len(own), wide)), far_degree, alpha)
    # reverse edges: the nearest few that point at a node
    a = np.repeat(np.arange(n), degree)
    b = edges.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.lexsort((-np.einsum("nd,nd->n", x[a], x[b]), b))
    a, b = a[order], b[order]
    rank = np.arange(len(b)) - np.searchsorted(b, b)
    back = np.full((n, degree), -1, dtype=np.int64)
    few = rank < degree
    back[b[few], rank[few]] = a[few]
    return np.concatenate([edges, back], axis=1)


def medoids(x: np.ndarray, count: int) -> np.ndarray:
    """The vector nearest to the middle, then those farthest from all chosen so far."""
    out = [int((x @ x.mean(axis=0)).argmax())]
    close = x @ x[out[0]]
    while len(out) < min(count, len(x)):
        out.append(int(close.argmin()))
        close = np.maximum(close, x @ x[out[-1]])
    return np.array(out)


def within(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, own: np.ndarray, least: float, beam: int = 24, slack: float = 0.02):
    """Nodes at least ``least`` close to each query: yields (query, node) arrays, by blocks of queries.

    Greedy search keeps the ``beam`` best nodes seen and expands the best that it has not expanded. Once none is left,
    the range grows: the neighbours of each node in range are looked at until no new one is in range.
    own: the query's node in the graph (-1: none), an entry beside the medoids.
    """
    n = len(x)
    block = max(1, min(len(queries), 1_000_000 // max(n, 1)))
    for at in range(0, len(queries), block):
        q, mine = queries[at : at + block], own[at : at + block]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), dtype=bool)
        nodes = np.concatenate([np.tile(entries, (len(q), 1)), mine[:, None]], axis=1)
        score = np.where(nodes >= 0, np.einsum("qkd,qd->qk", x[np.maximum(nodes, 0)], q), -np.inf)
        seen[np.repeat(rows, nodes.shape[1])[(nodes >= 0).ravel()], nodes[nodes >= 0]] = True
        done = np.zeros(nodes.shape, dtype=bool) | (nodes < 0)
        found_q, found_n = [], []

        def note(r, m, s):
            hit = s >= least - slack
            found_q.append(r[hit])  # noqa: B023
            found_n.append(m[hit])  # noqa: B023

        note(np.repeat(rows, nodes.shape[1]), nodes.ravel(), score.ravel())
        live = rows
        while len(live):
            open_score = np.where(done[live], -np.inf, score[live])
            best = open_score.argmax(axis=1)
            some = np.isfinite(open_score[np.arange(len(live)), best])
            live, best = live[some], best[some]
            if not len(live):
                break
            done[live, best] = True
            next_nodes = edges[nodes[live, best]]
            fresh = (next_nodes >= 0) & ~seen[live[:, None], np.maximum(next_nodes, 0)]
            r, k = np.nonzero(fresh)
            m = next_nodes[r, k]
            seen[live[r], m] = True
            s = np.full(next_nodes.shape, -np.inf)
            s[r, k] = np.einsum("kd,kd->k", x[m], q[live[r]])
            note(live[r], m, s[r, k])
            all_nodes = np.concatenate([nodes[live], np.where(fresh, next_nodes, -1)], axis=1)
            all_score = np.concatenate([score[live], s], axis=1)
            all_done = np.concatenate([done[live], ~fresh], axis=1)
            keep = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
            if nodes.shape[1] < keep.shape[1]:
                grow = keep.shape[1] - nodes.shape[1]
                nodes = np.pad(nodes, ((0, 0), (0, grow)), constant_values=-1)
                score = np.pad(score, ((0, 0), (0, grow)), constant_values=-np.inf)
                done = np.pad(done, ((0, 0), (0, grow)), constant_values=True)
            width = keep.shape[1]
            nodes[live, :width] = np.take_along_axis(all_nodes, keep, axis=1)
            score[live, :width] = np.take_along_axis(all_score, keep, axis=1)
            done[live, :width] = np.take_along_axis(all_done, keep, axis=1)
            if nodes.shape[1] > width:
                nodes[live, width:], score[live, width:], done[live, width:] = -1, -np.inf, True
        r, m = np.concatenate(found_q), np.concatenate(found_n)
        out_q, out_n = [r], [m]
        width, count = edges.shape[1], len(r)
        while len(r):  # range expansion, some nodes at a time
            if count > DENSE * len(q) * n:
                # many are in range of one another, as in a group of near copies: no walk is shorter than all of them
                hit_r, hit_m = np.nonzero(q @ x.T >= least - slack)
                out_q, out_n = [hit_r], [hit_m]
                break
            next_r, next_m = [], []
            for k in range(0, len(r), max(1, PAIRS // width)):
                own_r, own_m = r[k : k + max(1, PAIRS // width)], m[k : k + max(1, PAIRS // width)]
                to = edges[own_m].ravel()
                real = to >= 0
                pair = np.unique(np.repeat(own_r, width)[real] * n + to[real])
                grown_r, grown_m = pair // n, pair % n
                new = ~seen[grown_r, grown_m]
                grown_r, grown_m = grown_r[new], grown_m[new]
                seen[grown_r, grown_m] = True
                hit = cosines(x, grown_m, q, grown_r) >= least - slack
                next_r.append(grown_r[hit])
                next_m.append(grown_m[hit])
            r, m = np.concatenate(next_r), np.concatenate(next_m)
            count += len(r)
            out_q.append(r)
            out_n.append(m)
        yield np.concatenate(out_q) + at, np.concatenate(out_n)

"""Geometric near-neighbour access trees: exact searches for inner products within a window.

Vectors of integers are lifted onto a sphere by one more coordinate, so that the inner product of
a query and a row falls as their distance grows, and a window of products is an annulus round the
query. Each node has a few split points; a row belongs to the nearest one. For each split point
the node stores the least and greatest distance to the rows of every sibling subtree. A subtree is
left out when, for some split point, that range does not meet the range of distances which the
annulus allows. Leaves are searched exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Share of the sphere's radius by which computed distances may be off.
SLACK = 1e-6


@dataclass
class Split:
    """A node: split points on the sphere, their children (a node, or -1 - leaf), and the ranges."""

    points: np.ndarray
    children: list[int]
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.points)
        self.low, self.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)


@dataclass
class Tree:
    radius: float
    nodes: list[Split]
    leaves: int

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Rows on the sphere of ``radius``."""
        rest = np.sqrt(np.maximum(self.radius**2 - (vectors**2).sum(1), 0))
        return np.hstack([vectors, rest[:, None]])

    @staticmethod
    def ask(vectors: np.ndarray) -> np.ndarray:
        """Queries in the same space."""
        return np.hstack([vectors, np.zeros((len(vectors), 1))])

    def annulus(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of rows whose product with the query is in [low, high]."""
        size = (vectors**2).sum(1) + self.radius**2
        return np.sqrt(np.maximum(size - 2 * high, 0)), np.sqrt(np.maximum(size - 2 * low, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def _choose(points: np.ndarray, fan: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``fan`` different rows of ``points`` that lie far apart, out of three times as many."""
    some = points[rng.choice(len(points), min(3 * fan, len(points)), replace=False)]
    picked, far = [0], distances(some, some[:1])[:, 0]
    while len(picked) < fan:
        k = int(far.argmax())
        if far[k] <= SLACK * np.abs(some).max():
            break
        picked.append(k)
        far = np.minimum(far, distances(some, some[k : k + 1])[:, 0])
    return some[picked]


def grow(vectors: np.ndarray, radius: float, fan: int, leaf_rows: int, seed: int = 0) -> tuple[Tree, np.ndarray]:
    """A tree over ``vectors`` with leaves of about ``leaf_rows``, and the leaf of each row.

    Rows that no split point tells apart stay in one leaf, however many they are.
    """
    rng, tree = np.random.default_rng(seed), Tree(radius, [], 0)
    points, leaf = tree.lift(vectors), np.zeros(len(vectors), np.int64)

    def place(rows: np.ndarray) -> int:
        if len(rows) > leaf_rows:
            chosen = _choose(points[rows], fan, rng)
            if len(chosen) > 1:
                nearest = distances(points[rows], chosen).argmin(1)
                if np.bincount(nearest).max() < len(rows):
                    node = Split(chosen, [])
                    tree.nodes.append(node)
                    at = len(tree.nodes) - 1
                    node.children += [place(rows[nearest == k]) for k in range(len(chosen))]
                    return at
        leaf[rows] = tree.leaves
        tree.leaves += 1
        return -tree.leaves

    place(np.arange(len(vectors)))
    return tree, leaf


def note_ranges(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """Route ``vectors`` down the tree, widening the ranges on their way; the leaf of each."""
    leaf, points = np.zeros(len(vectors), np.int64), tree.lift(vectors)
    todo = [(0, np.arange(len(vectors)))] if tree.nodes else []
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        node = tree.nodes[at]
        far = distances(points[rows], node.points)
        nearest = far.argmin(1)
        for k, child in enumerate(node.children):
            mine = nearest == k
            if mine.any():
                node.low[:, k] = np.minimum(node.low[:, k], far[mine].min(0))
                node.high[:, k] = np.maximum(node.high[:, k], far[mine].max(0))
                if child < 0:
                    leaf[rows[mine]] = -1 - child
                else:
                    todo.append((child, rows[mine]))
    return leaf


def home(tree: Tree, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A leaf likely to hold the first rows of each query's window; any leaf would be right."""
    leaf, asked = np.zeros(len(queries), np.int64), tree.ask(queries)
    inner, _ = tree.annulus(queries, low, high)
    todo = [(0, np.arange(len(queries)))] if tree.nodes else []
    while todo:
        at, some = todo.pop()
        node = tree.nodes[at]
        best = np.abs(distances(asked[some], node.points) - inner[some, None]).argmin(1)
        for k, child in enumerate(node.children):
            if (mine := some[best == k]).size:
                if child < 0:
                    leaf[mine] = -1 - child
                else:
                    todo.append((child, mine))
    return leaf


def _meets(tree: Tree, node: Split, far: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Queries by children: whether every split point's range meets the annulus."""
    slack = SLACK * tree.radius
    low, high = node.low[None], node.high[None]
    to = far[:, :, None]
    near, wide = inner[:, None, None], outer[:, None, None]
    return ((to - wide <= high + slack) & (to + wide >= low - slack) & (to + high >= near - slack)).all(1)


def reach(tree: Tree, queries: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Yield (leaf, queries that may find a row there).

    ``low`` is read anew at each node, so a caller may raise it while the search runs.
    """
    asked = tree.ask(queries)
    todo = [(0 if tree.nodes else -1, np.arange(len(queries)))]
    while todo:
        at, some = todo.pop()
        if not len(some):
            continue
        if at < 0:
            yield -1 - at, some
            continue
        node = tree.nodes[at]
        for first in range(0, len(some), 512):
            part = some[first : first + 512]
            inner, outer = tree.annulus(queries[part], low[part], high[part])
            alive = _meets(tree, node, distances(asked[part], node.points), inner, outer)
            todo += [(child, part[alive[:, k]]) for k, child in enumerate(node.children)]


@dataclass
class Windows:
    """Searches: per query a window of products, the labels wanted (its own, or others), and how many rows."""

    vectors: np.ndarray
    labels: np.ndarray
    same: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    top = (np.abs(a).max(initial=0) + 1.0) * (np.abs(b).max(initial=0) + 1.0) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


NONE = -(1 << 62)


def first_rows(rows: np.ndarray, labels: np.ndarray, asked: Windows, radius: float, fan: int, leaf_rows: int):
    """(query, row, product) of the first ``n`` rows of each window by product, with all ties of the last.

    A tree over ``rows`` is searched twice: one leaf per query for a first bound, then every leaf
    that the bound does not rule out.
    """
    tree, leaf = grow(rows.astype(np.float64), radius, fan, leaf_rows)
    note_ranges(tree, rows.astype(np.float64))
    order = np.argsort(leaf, kind="stable")
    starts = np.searchsorted(leaf[order], np.arange(tree.leaves + 1))
    most, count = int(asked.n.max()), len(asked.n)
    queries, low = asked.vectors.astype(np.float64), asked.low.astype(np.int64).copy()
    best = np.full((count, most), NONE)
    own_last = asked.n - 1

    def scores(at: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = order[starts[at] : starts[at + 1]]
        found = products(asked.vectors[some], rows[mine])
        fits = (labels[mine][None, :] == asked.labels[some, None]) == asked.same[some, None]
        fits &= (found >= low[some, None]) & (found <= asked.high[some, None])
        return mine, np.where(fits, found, NONE)

    def raise_bounds(some: np.ndarray, found: np.ndarray) -> None:
        both = np.hstack([best[some], found])
        best[some] = -np.sort(-both, axis=1)[:, :most] if both.shape[1] <= 64 else -np.sort(np.partition(-both, most, axis=1)[:, :most], axis=1)
        low[some] = np.maximum(low[some], best[some, own_last[some]])

    first = home(tree, queries, low, asked.high)
    for at in np.unique(first):
        some = np.flatnonzero(first == at)
        raise_bounds(some, scores(at, some)[1])
    best[:] = NONE
    out = []
    for at, some in reach(tree, queries, low, asked.high):
        mine, found = scores(at, some)
        q, r = np.nonzero(found != NONE)
        out.append((some[q], mine[r], found[q, r]))
        raise_bounds(some, found)
    q, r, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    kept = s >= low[q]
    return q[kept], r[kept], s[kept]

"""Gradient boosted trees for a yes/no label: histogram splits, logistic loss, Newton leaves.

Rows are held in blocks (bins, positives, number, score); a block's row may stand for many equal examples. A tree's level needs
only the sum of the blocks' histograms, so blocks may lie in one process (`fit`) or be spread over Spark (`fit_blocks`, one
job a level). Gradients are rounded to 1 / ``EXACT``: their sums are exact, so the trees depend neither on the order of rows
nor on how they are dealt.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np

EXACT = 2.0 ** 20
#: Scores of the blocks are brought up to date after so many trees.
REFRESH = 10


@dataclass
class Boosted:
    edges: list            # per feature: upper bounds of its bins
    feature: np.ndarray    # (trees, inner nodes); -1: the node does not split
    cut: np.ndarray        # bins up to this one go left
    leaf: np.ndarray       # (trees, leaves)
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        return self.added(b, np.full(len(b), self.start), 0, len(self.feature))

    def added(self, b: np.ndarray, raw: np.ndarray, first: int, last: int) -> np.ndarray:
        """Scores with those of the trees ``first`` to ``last`` - 1."""
        out, depth = raw.copy(), int(np.log2(self.leaf.shape[1]))
        for t in range(first, last):
            out += self.leaf[t][self.node(b, t, depth) - self.feature.shape[1]]
        return out

    def node(self, b: np.ndarray, tree: int, levels: int) -> np.ndarray:
        at, rows, f, c = np.zeros(len(b), np.int64), np.arange(len(b)), self.feature[tree], self.cut[tree]
        for _ in range(levels):
            k = f[at]
            at = 2 * at + 1 + ((k >= 0) & (b[rows, k] > c[at]))
        return at


def binned(x, edges):
    return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), np.int64)


def bounds(values: np.ndarray, counts: np.ndarray, bins: int = 32) -> np.ndarray:
    """Upper bounds of a feature's bins: quantiles of its values (ascending), each there ``counts`` times."""
    upto = counts.cumsum()
    return np.unique(values[np.searchsorted(upto, np.linspace(0, 1, bins)[:-1] * (upto[-1] - 1), side="right")])


def block(x: np.ndarray, positives: np.ndarray, number: np.ndarray, edges: list, start: float) -> tuple:
    """A block of at most 255 bins a feature."""
    return binned(x, edges).astype(np.uint8), positives, number, np.full(len(x), start)


def start_of(share: float) -> float:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)))


def histograms(held: tuple, model: Boosted, done: int, tree: int, level: int) -> np.ndarray:
    """Sums of gradients and of curvatures of a block: (2, features, nodes of the level, bins)."""
    b, positives, number, raw = held
    p = 1 / (1 + np.exp(-model.added(b, raw, done, tree)))
    g = np.rint(p * EXACT) / EXACT * number - positives
    h = np.rint(p * (1 - p) * EXACT) / EXACT * number
    nodes, width = 2 ** level, max(map(len, model.edges)) + 1
    at = (model.node(b, tree, level) - (nodes - 1)) * width
    return np.stack([[np.bincount(at + c, v, nodes * width).reshape(nodes, width) for c in b.T] for v in (g, h)])


def refreshed(held: tuple, model: Boosted, done: int, tree: int) -> tuple:
    return *held[:3], model.added(held[0], held[3], done, tree)


def grown(edges: list, start: float, total, keep, trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 1.0) -> Boosted:
    """``total(f)`` is the sum of f over all blocks, ``keep(f)`` replaces each block by f of it."""
    inner = 2 ** depth - 1
    model = Boosted(edges, np.full((trees, inner), -1), np.zeros((trees, inner), np.int64), np.zeros((trees, inner + 1)), start)
    done = 0
    for t in range(trees):
        if t - done == REFRESH:
            keep(partial(refreshed, model=model, done=done, tree=t))
            done = t
        for level in range(depth):
            n = 2 ** level
            g, h = total(partial(histograms, model=model, done=done, tree=t, level=level))
            best, gain, where = np.full(n, -1), np.full(n, 1e-6), np.zeros(n, np.int64)
            nodes = np.arange(n)
            gt, ht = g[0].sum(1), h[0].sum(1)
            gleft, hleft = gt.copy(), ht.copy()
            for k, (gl, hl) in enumerate(zip(g.cumsum(2), h.cumsum(2))):
                gr, hr = gt[:, None] - gl, ht[:, None] - hl
                score = gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - (gt ** 2 / (ht + 1))[:, None]
                score[(hl < least) | (hr < least)] = 0
                top = score.argmax(1)
                better = score[nodes, top] > gain
                best[better], where[better], gain[better] = k, top[better], score[nodes, top][better]
                gleft[better], hleft[better] = gl[nodes, top][better], hl[nodes, top][better]
            model.feature[t, n - 1:2 * n - 1], model.cut[t, n - 1:2 * n - 1] = best, where
        gs, hs = np.stack([gleft, gt - gleft], 1).ravel(), np.stack([hleft, ht - hleft], 1).ravel()
        model.leaf[t] = -rate * gs / (hs + 1)
    return model


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, **options) -> Boosted:
    edges, start = [bounds(*np.unique(c, return_counts=True), bins) for c in x.T], start_of(y.mean())
    held = [block(x, y, np.ones(len(y)), edges, start)]

    def keep(f):
        held[0] = f(held[0])

    return grown(edges, start, lambda f: f(held[0]), keep, **options)


def fit_blocks(blocks, edges: list, start: float, **options) -> Boosted:
    """Trees of all rows of an RDD of blocks. Runs a job a level; a block sends one histogram."""
    held = blocks.persist()

    def keep(f):
        nonlocal held
        before, held = held, held.map(f).persist()
        held.count()
        before.unpersist()

    try:
        return grown(edges, start, lambda f: held.map(f).reduce(np.add), keep, **options)
    finally:
        held.unpersist()

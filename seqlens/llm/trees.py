"""Gradient-boosted trees in numpy: fitted on a bounded sample, flattened into node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Nodes of all trees in one set of arrays. A leaf is its own child; roots: the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], trees: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: int = 10) -> Forest:
    """Logistic boosting on histograms. monotone: for each feature +1, -1 or 0, the sign its effect must have.

    A split whose leaves would go against a feature's sign is not made, and what lies below a split on such a feature
    is held to its side of the middle of the two leaves' values; so every tree, and the sum, is monotone."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    p = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    raw = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        n = len(feature)
        for own, what in ((feature, 0), (threshold, 0.0), (left, n), (right, n), (value, v * rate)):
            own.append(what)
        return n

    def weight(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + l2), low), high)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        node = leaf(weight(g, h, low, high))
        if level == depth or len(rows) < 2 * least:
            return node
        best = (1e-6, -1, -1, 0.0, 0.0)

        def gain(g: float, h: float, w: float) -> float:
            return -(g * w + 0.5 * (h + l2) * w * w)

        here = gain(g, h, weight(g, h, low, high))
        for f in range(x.shape[1]):
            own = binned[rows, f]
            n = len(edges[f]) + 1
            gs, hs, cs = (np.bincount(own, w, n).cumsum()[:-1] for w in (grad[rows], hess[rows], None))
            for b in np.flatnonzero((cs >= least) & (cs <= len(rows) - least)):
                wl, wr = weight(gs[b], hs[b], low, high), weight(g - gs[b], h - hs[b], low, high)
                if monotone[f] * (wr - wl) < 0:
                    continue
                made = gain(gs[b], hs[b], wl) + gain(g - gs[b], h - hs[b], wr) - here
                if made > best[0]:
                    best = (made, f, int(b), wl, wr)
        _, f, b, wl, wr = best
        if f < 0:
            return node
        feature[node], threshold[node] = f, float(edges[f][b])
        go = binned[rows, f] <= b
        middle = (wl + wr) / 2
        lower, upper = ((low, middle), (middle, high)) if monotone[f] > 0 else ((middle, high), (low, middle)) if monotone[f] < 0 else ((low, high), (low, high))
        left[node], right[node] = grow(rows[go], level + 1, *lower), grow(rows[~go], level + 1, *upper)
        return node

    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        grad, hess = q - y, q * (1 - q)
        root = len(feature)
        grow(np.arange(len(y)), 0, -np.inf, np.inf)
        roots.append(root)
        tree = Forest(*(np.array(a) for a in (feature, threshold, left, right, value)), np.array([root]), depth, 0.0)
        raw = raw + tree.raw(x)
    return Forest(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32), depth, base)

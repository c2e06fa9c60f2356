"""Gradient-boosted shallow trees for two classes, fitted with histograms of binned features.

Defined cases: features are finite numbers (callers turn what is missing into 0); of equal gains the first feature and the
lowest edge win, so a fit depends on the rows alone; labels of one class, or none, give the base rate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS, DEPTH, TREES, RATE, LEAST = 32, 3, 60, 0.2, 8


@dataclass
class Boosted:
    """A complete tree of DEPTH levels is DEPTH rows of (feature, edge) for each node, and its leaf values."""

    base: float = 0.0
    depth: int = DEPTH
    feature: list[np.ndarray] = field(default_factory=list)
    edge: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, e, v in zip(self.feature, self.edge, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > e[at])
            out += v[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Boosted:
    """Newton boosting of the logistic loss; with one class only (or no rows) the base rate alone."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), depth)
    if not len(y) or y.min() == y.max():
        return model
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    bins = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]  # bin b: edges[b-1] < x <= edges[b]
    f, inner = np.full(len(y), model.base), 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, edge, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            split = np.zeros(nodes, np.int64)
            for j in range(k):
                width = len(edges[j]) + 1
                if width < 2:
                    continue
                cell = (at - first) * width + bins[j]
                gs = np.bincount(cell, g, nodes * width).reshape(nodes, width).cumsum(1)
                hs = np.bincount(cell, h, nodes * width).reshape(nodes, width).cumsum(1)
                ns = np.bincount(cell, minlength=nodes * width).reshape(nodes, width).cumsum(1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
                b = gain[:, :-1].argmax(1)
                top = gain[np.arange(nodes), b]
                better = top > best
                best[better], split[better] = top[better], b[better]
                feature[first : first + nodes][better] = j
                edge[first : first + nodes][better] = edges[j][b[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > edge[at])
        cell = at - inner
        leaf = RATE * np.bincount(cell, g, inner + 1) / (np.bincount(cell, h, inner + 1) + 1)
        model.feature.append(feature)
        model.edge.append(edge)
        model.leaf.append(leaf)
        f += leaf[cell]
    return model

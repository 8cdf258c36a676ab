"""Gradient-boosted trees for binary targets, in numpy: histogram splits, logistic loss."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from tidemark.llm.common import sigmoid

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class BoostedTrees:
    """Trees of fixed depth stored level by level: node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, n_trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.l2 = n_trees, depth, rate, bins, l2
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if not len(y):
            return self
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        score = np.full(len(y), self.start)
        inner = 2**self.depth - 1
        for _ in range(self.n_trees):
            p = sigmoid(score)
            g, h = p - y, p * (1 - p)
            feature, limit, leaf = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(2**self.depth)
            at = np.zeros(len(y), dtype=np.int64)
            for node in range(inner):
                rows = np.nonzero(at == node)[0]
                best = self._split(binned[rows], g[rows], h[rows]) if len(rows) > 1 else None
                right = np.zeros(len(rows), dtype=bool)
                if best is not None:
                    f, b = best
                    feature[node], limit[node] = f, edges[f][b]
                    right = binned[rows, f] > b
                at[rows] = 2 * node + 1 + right
            for k in range(len(leaf)):
                rows = at == inner + k
                leaf[k] = -self.rate * g[rows].sum() / (h[rows].sum() + self.l2)
            self.trees.append((feature, limit, leaf))
            score += leaf[at - inner]
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        total_g, total_h = g.sum(), h.sum()
        best, gain = None, 1e-6
        for f in range(binned.shape[1]):
            n = int(binned[:, f].max()) + 1
            if n < 2:
                continue
            left_g = np.cumsum(np.bincount(binned[:, f], weights=g, minlength=n))[:-1]
            left_h = np.cumsum(np.bincount(binned[:, f], weights=h, minlength=n))[:-1]
            own = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2)
            k = int(np.argmax(own))
            if own[k] - total_g**2 / (total_h + self.l2) > gain:
                best, gain = (f, k), own[k] - total_g**2 / (total_h + self.l2)
        return best

    def logit(self, x: np.ndarray) -> np.ndarray:
        score, every, inner = np.full(len(x), self.start), np.arange(len(x)), 2**self.depth - 1
        for feature, limit, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[every, feature[at]] > limit[at])
            score += leaf[at - inner]
        return score

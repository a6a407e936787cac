"""Histogram gradient-boosted trees for binary labels, in numpy: fitted on quantile bins, stored as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Node arrays of all trees, root after root. A leaf is its own child on both sides."""

    base: float
    depth: int = 0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All rows walk one level of one tree at a time."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """x: rows x features; y: 0 or 1. A single class, or no rows, gives its (smoothed) share as every score."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
    width, n_f = bins, x.shape[1]
    flat = binned + np.arange(n_f) * width
    margin = np.full(n, base)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def add() -> int:
        at = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(at)
        right.append(at)
        value.append(0.0)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        root = add()
        roots.append(root)
        node = np.full(n, root)
        level = [root]
        for d in range(depth + 1):
            nxt = []
            for at in level:
                own = np.flatnonzero(node == at)
                g_sum, h_sum = g[own].sum(), h[own].sum()
                value[at] = rate * g_sum / (h_sum + l2)
                if d == depth or h_sum < 2 * least:
                    continue
                idx = flat[own].ravel()
                hist_g = np.bincount(idx, np.repeat(g[own], n_f), n_f * width).reshape(n_f, width).cumsum(1)
                hist_h = np.bincount(idx, np.repeat(h[own], n_f), n_f * width).reshape(n_f, width).cumsum(1)
                gain = hist_g**2 / (hist_h + l2) + (g_sum - hist_g) ** 2 / (h_sum - hist_h + l2) - g_sum**2 / (h_sum + l2)
                gain[(hist_h < least) | (h_sum - hist_h < least)] = -np.inf
                for f, c in enumerate(cuts):
                    gain[f, len(c) :] = -np.inf
                best = int(gain.argmax())
                if not gain.flat[best] > 1e-6:
                    continue
                f, b = divmod(best, width)
                feature[at], threshold[at] = f, cuts[f][b]
                left[at], right[at] = add(), add()
                goes = binned[own, f] <= b
                node[own[goes]], node[own[~goes]] = left[at], right[at]
                nxt += [left[at], right[at]]
            level = nxt
        margin += np.array(value)[node]
    arrays = (np.array(a, t) for a, t in ((roots, np.int32), (feature, np.int32), (threshold, float), (left, np.int32), (right, np.int32), (value, float)))
    return Trees(base, depth, *arrays)

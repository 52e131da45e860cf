"""Gradient-boosted trees for a yes/no target, small and in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Complete trees of one depth, as arrays: feature, threshold, leaf value."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def logits(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1]))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - (2**depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, penalty: float = 1.0, least: int = 10) -> Trees:
    """Second-order boosting on histograms of quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    flat = binned + np.arange(width) * BINS
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    out, features, thresholds, values = np.full(n, base), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-out))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(n, np.int64)
        for node in range(2**depth - 1):
            here = np.flatnonzero(at == node)
            if len(here) >= 2 * least:
                size = width * BINS
                sums = [np.bincount(flat[here].ravel(), np.repeat(w[here], width), size).reshape(width, BINS) for w in (g, h, np.ones(n))]
                left = [s.cumsum(1) for s in sums]
                all_ = [s.sum(1, keepdims=True) for s in sums]
                gain = sum((a[0] ** 2 / (a[1] + penalty)) for a in (left, [t - s for t, s in zip(all_, left)])) - all_[0] ** 2 / (all_[1] + penalty)
                gain[(left[2] < least) | (all_[2] - left[2] < least)] = 0
                j, b = divmod(int(gain.argmax()), BINS)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    feature[node], threshold[node] = j, edges[j][b]
            at[here] = 2 * node + 1 + (x[here, feature[node]] > threshold[node])
        leaf = at - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + penalty)
        out += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.stack(features), np.stack(thresholds), np.stack(values))

"""Gradient-boosted trees for a binary target, in numpy: histograms of quantile bins, complete trees of fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 4.0, ridge: float = 1.0, columns: float = 0.5, seed: int = 1):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge, self.columns, self.seed = trees, depth, rate, bins, least, ridge, columns, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, k = x.shape
        self.edges = []
        for j in range(k):
            seen = np.unique(x[:, j])  # few values: every border between them; else quantiles
            self.edges.append((seen[1:] + seen[:-1]) / 2 if len(seen) <= self.bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])))
        q = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p0 / (1 - p0)))
        f = np.full(n, self.start)
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        self.feature = np.zeros((self.trees, inner), dtype=np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.value = np.zeros((self.trees, leaves))
        rng = np.random.default_rng(self.seed)
        for t in range(self.trees):
            use = np.sort(rng.choice(k, max(1, int(k * self.columns)), replace=False))
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(n, dtype=np.int64)  # node within the level
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.full(width, 1e-9)
                feat, bin_ = np.zeros(width, dtype=np.int64), np.full(width, self.bins, dtype=np.int64)
                for j in use:
                    m = self.bins + 1
                    key = at * m + q[:, j]
                    gs = np.bincount(key, g, width * m).reshape(width, m).cumsum(1)
                    hs = np.bincount(key, h, width * m).reshape(width, m).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    b = gain.argmax(1)
                    better = gain[np.arange(width), b] > best
                    best[better] = gain[np.arange(width), b][better]
                    feat[better], bin_[better] = j, b[better]
                self.feature[t, first : first + width] = feat
                for node in range(width):
                    e = self.edges[feat[node]]
                    # bin b holds values below edge b: rows up to bin b go left
                    self.cut[t, first + node] = e[bin_[node]] if bin_[node] < len(e) else np.inf
                right = x[np.arange(n), feat[at]] >= self.cut[t, first + at]
                at = 2 * at + right
            gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
            self.value[t] = self.rate * gs / (hs + self.ridge)
            f += self.value[t][at]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for t in range(self.trees):
            at = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = 2 * at + (x[rows, self.feature[t, node]] >= self.cut[t, node])
            out += self.value[t][at]
        return out

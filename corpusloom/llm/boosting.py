"""Gradient-boosted trees for two classes in numpy: logistic loss, histogram splits, fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, bin, leaf values
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), dtype=np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(d)]
        b, nb = self._binned(x), self.bins + 1
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            at = np.zeros(n, dtype=np.int64)
            feature, cut = np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, nb, dtype=np.int64)
            for level in range(self.depth):
                k = 2**level
                best = np.full(k, 1e-9)
                for f in range(d):
                    cell = at * nb + b[:, f]
                    gs = np.bincount(cell, g, k * nb).reshape(k, nb).cumsum(axis=1)
                    hs = np.bincount(cell, h, k * nb).reshape(k, nb).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    gain = np.where((hs >= self.least / 4) & (ht - hs >= self.least / 4), gain, 0)
                    where = gain.argmax(axis=1)
                    top = gain[np.arange(k), where]
                    for node in np.nonzero(top > best)[0]:
                        best[node] = top[node]
                        feature[k - 1 + node], cut[k - 1 + node] = f, where[node]
                at = at * 2 + (b[np.arange(n), feature[k - 1 + at]] > cut[k - 1 + at])
            leaves = np.bincount(at, g, 2**self.depth) / (np.bincount(at, h, 2**self.depth) + self.penalty) * self.rate
            score += leaves[at]
            self.nodes.append((feature, cut, leaves))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the second class."""
        b = self._binned(x)
        score = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for feature, cut, leaves in self.nodes:
            at = np.zeros(len(b), dtype=np.int64)
            for level in range(self.depth):
                k = 2**level - 1
                at = at * 2 + (b[rows, feature[k + at]] > cut[k + at])
            score += leaves[at]
        return 1 / (1 + np.exp(-score))

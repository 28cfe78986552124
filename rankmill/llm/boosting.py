"""Gradient-boosted regression trees for a yes/no target, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Logistic boosting; every tree is complete, with ``depth`` levels of (feature, threshold) splits."""

    depth: int = 4
    rounds: int = 40
    rate: float = 0.3
    bins: int = 32
    penalty: float = 1.0
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)], axis=1)
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, threshold = np.zeros(2**self.depth - 1, dtype=int), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), dtype=int)
            for level in range(self.depth):
                first = 2**level - 1
                gain, pick, cut = self._splits(binned, node - first, 2**level, g, h)
                for k in range(2**level):
                    if gain[k] > 1e-6:
                        feature[first + k], threshold[first + k] = pick[k], edges[pick[k]][cut[k]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
            leaf = node - (2**self.depth - 1)
            sums, mass = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            value = self.rate * sums / (mass + self.penalty)
            score += value[leaf]
            self.features.append(feature)
            self.thresholds.append(threshold)
            self.leaves.append(value)
        return self

    def _splits(self, binned: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray):
        """Best gain, feature and bin edge of every node of a level."""
        best = np.zeros(nodes), np.zeros(nodes, dtype=int), np.zeros(nodes, dtype=int)
        for f in range(binned.shape[1]):
            width = binned[:, f].max() + 1
            if width < 2:
                continue
            cell = node * width + binned[:, f]
            left_g = np.bincount(cell, g, nodes * width).reshape(nodes, width).cumsum(axis=1)
            left_h = np.bincount(cell, h, nodes * width).reshape(nodes, width).cumsum(axis=1)
            all_g, all_h = left_g[:, -1:], left_h[:, -1:]
            part = lambda a, b: a * a / (b + self.penalty)
            gain = (part(left_g, left_h) + part(all_g - left_g, all_h - left_h) - part(all_g, all_h))[:, :-1]
            cut = gain.argmax(axis=1)
            top = gain[np.arange(nodes), cut]
            better = top > best[0]
            best[0][better], best[1][better], best[2][better] = top[better], f, cut[better]
        return best

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            score += value[node - (2**self.depth - 1)]
        return score

"""Gradient-boosted trees for a binary outcome, in numpy, and calibration of thresholds."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of trees of fixed depth over features cut at quantiles; deterministic."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)  # v <= cut goes left
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        score, width = np.full(len(y), self.base), self.bins + 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            n = 2**self.depth
            feature, cut, node = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(len(y), np.int64)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    at = np.flatnonzero(node == k)
                    best = (1e-6, 0, 0)
                    for f, c in enumerate(cuts):
                        if not len(c) or len(at) < 8:
                            continue
                        b = binned[at, f]
                        gl, hl = np.cumsum(np.bincount(b, g[at], width))[: len(c)], np.cumsum(np.bincount(b, h[at], width))[: len(c)]
                        gs, hs = g[at].sum(), h[at].sum()
                        gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                        j = int(gain.argmax())
                        if gain[j] > best[0] + 1e-12:
                            best = (float(gain[j]), f, j)
                    if best[0] > 1e-6:
                        feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
                    node[at] = 2 * k + (x[at, feature[k]] > cut[k])
            leaf = np.bincount(node - n, g, n) / (np.bincount(node - n, h, n) + self.ridge) * self.rate
            score += leaf[node - n]
            self.grown.append((feature, cut, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, n = np.full(len(x), self.base), 2**self.depth
        for feature, cut, leaf in self.grown:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[np.arange(len(x)), feature[node]] > cut[node])
            score += leaf[node - n]
        return 1 / (1 + np.exp(-score))


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least cut at which all cuts above it have the wanted precision on held-out rows; 2 where none has."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)
    ok = np.flatnonzero(last & (hit >= precision))
    return float(p[order][ok[-1]]) if len(ok) else 2.0

"""Gradient-boosted trees for two classes, with calibrated thresholds. NumPy only; a model is a few kilobytes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class BoostedTrees:
    """Logistic loss, trees of fixed depth grown level by level on binned features."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.25
    ridge: float = 1.0
    base: float = 0.0
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)  # value > edge[b-1]
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = sigmoid(score)
            g, h = y - p, p * (1 - p)
            feature, cut, at = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf), np.zeros(len(y), int)
            for level in range(self.depth):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = np.flatnonzero(at == node)
                    best = (1e-3, 0, np.inf)
                    whole = g[own].sum() ** 2 / (h[own].sum() + self.ridge) if len(own) else 0
                    for f, e in enumerate(edges):
                        if not len(own) or not len(e):
                            continue
                        gs, hs = (np.cumsum(np.bincount(binned[own, f], weights=v[own], minlength=len(e) + 1))[:-1] for v in (g, h))
                        gain = gs**2 / (hs + self.ridge) + (g[own].sum() - gs) ** 2 / (h[own].sum() - hs + self.ridge) - whole
                        if gain.max() > best[0]:
                            best = (gain.max(), f, e[gain.argmax()])
                    feature[node], cut[node] = best[1:]
                    at[own] = 2 * node + 1 + (x[own, feature[node]] > cut[node])
            leaf = at - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            score += value[leaf]
            self.nodes.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            score += value[at - (2**self.depth - 1)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on held-out rows, by Newton steps."""
        m, (a, b) = self.margin(x), self.scale
        for _ in range(50):
            p = sigmoid(a * m + b)
            w, r = p * (1 - p) + 1e-9, p - y
            grad = np.array([(r * m).sum() + 1e-3 * (a - 1), r.sum()])
            hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
        self.scale = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * self.margin(x) + self.scale[1])


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cutoff from which on at least ``precision`` of the held-out rows above it are positive; never under 1/2."""
    order = np.argsort(-p)
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision
    last = np.concatenate([p[order][1:] != p[order][:-1], [True]]) & good
    return max(0.5, float(p[order][np.flatnonzero(last)[-1]])) if last.any() else 1.1

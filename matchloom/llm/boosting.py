"""Small gradient-boosted trees for a bounded training table (numpy, binary log loss)."""

from __future__ import annotations

import numpy as np


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


class Boosted:
    """Trees of fixed depth over quantile bins; predict() gives probabilities, calibrated by a two-parameter logistic fit."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 24):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias, self.scale, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.bias)
        nodes = 2**self.depth - 1
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = y - prob, prob * (1 - prob)
            feature, cut, value = np.zeros(nodes, int), np.full(nodes, np.inf), np.zeros(nodes + 2**self.depth)
            at = np.zeros(len(y), int)
            for node in range(nodes):
                here = np.flatnonzero(at == node)
                best = (1e-6, 0, np.inf, None)
                if len(here) >= 8:
                    total_g, total_h = g[here].sum(), h[here].sum()
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        sg = np.cumsum(np.bincount(code[here, f], g[here], len(c) + 1))[:-1]
                        sh = np.cumsum(np.bincount(code[here, f], h[here], len(c) + 1))[:-1]
                        gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, float(c[k]), code[here, f] <= k)
                feature[node], cut[node] = best[1], best[2]
                left = np.ones(len(here), bool) if best[3] is None else best[3]
                at[here] = 2 * node + 2 - left
            for leaf in range(nodes, len(value)):
                value[leaf] = self.rate * _leaf(g[at == leaf], h[at == leaf]) if (at == leaf).any() else 0.0
            raw += value[at]
            self.forest.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.forest:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 2 - (x[rows, feature[at]] <= cut[at])
            out += value[at]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 5.0) -> "Boosted":
        """Fits the logistic scale and shift to held-out rows by Newton steps; ridge holds them near 1 and 0."""
        z, w = np.stack([self.raw(x), np.ones(len(x))], 1), np.array([1.0, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-z @ w))
            hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
            w = w + np.linalg.solve(hess, z.T @ (y - p) - ridge * (w - [1.0, 0.0]))
        self.scale, self.shift = map(float, w)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift))) if len(x) else np.zeros(0)


def threshold(p: np.ndarray, y: np.ndarray, precision: float, negatives: float = 1.0, least: float = 0.2) -> float:
    """The lowest score whose held-out precision is at least so high, halfway to the next below, and least at least; above 1 if there is none.

    negatives: how many negatives outside each held-out one stands for."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    right = hits / (hits + negatives * np.cumsum(1 - y[order]))
    ends = np.flatnonzero(np.append(np.diff(p[order]) != 0, True))
    good = ends[right[ends] >= precision]
    if not len(good):
        return 2.0
    at = good[-1]
    return max(least, float(p[order][at] + (p[order][at + 1] if at + 1 < len(y) else 0.0)) / 2)

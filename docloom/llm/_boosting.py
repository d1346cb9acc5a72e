"""Gradient-boosted trees for binary labels in numpy, with Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class _Tree:
    """Nodes in arrays; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for x, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            x.append(v)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            here = at[rows]
            at[rows] = np.where(x[rows, feature[here]] <= cut[here], left[here], right[here])
        return value[at]


class BoostedTrees:
    """Logistic loss, Newton steps, splits at up to ``bins`` quantiles of a feature."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, least: float = 5.0, penalty: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.least, self.penalty, self.bins = rounds, depth, rate, least, penalty, bins
        self.trees: list[_Tree] = []
        self.start, self.slope, self.shift = 0.0, 1.0, 0.0

    def _grow(self, tree: _Tree, x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> int:
        at, total_g, total_h = tree.add(), g[rows].sum(), h[rows].sum()
        tree.value[at] = -self.rate * total_g / (total_h + self.penalty)
        best = (1e-9, -1, 0.0)
        for j in range(x.shape[1]) if depth else ():
            side = np.searchsorted(cuts[j], x[rows, j])  # value <= cut[k] for k >= side
            sum_g = np.cumsum(np.bincount(side, g[rows], len(cuts[j]) + 1))[:-1]
            sum_h = np.cumsum(np.bincount(side, h[rows], len(cuts[j]) + 1))[:-1]
            ok = (sum_h >= self.least / 4) & (total_h - sum_h >= self.least / 4)
            gain = np.where(ok, sum_g**2 / (sum_h + self.penalty) + (total_g - sum_g) ** 2 / (total_h - sum_h + self.penalty) - total_g**2 / (total_h + self.penalty), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, cuts[j][gain.argmax()])
        if best[1] >= 0:
            below = x[rows, best[1]] <= best[2]
            tree.feature[at], tree.cut[at] = best[1], best[2]
            tree.left[at] = self._grow(tree, x, cuts, g, h, rows[below], depth - 1)
            tree.right[at] = self._grow(tree, x, cuts, g, h, rows[~below], depth - 1)
        return at

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1), method="lower"))[:-1] for j in range(x.shape[1])]
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = _sigmoid(score)
            tree = _Tree()
            self._grow(tree, x, cuts, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += tree.predict(x)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fit probability = sigmoid(slope * score + shift) to rows that were not trained on (Platt's targets)."""
        s, a, b = self.score(x), 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(50):
            p = _sigmoid(a * s + b)
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - target) * s).sum(), (p - target).sum()])
            hess = np.array([[(w * s * s).sum() + 1e-6, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.score(x) + self.shift)

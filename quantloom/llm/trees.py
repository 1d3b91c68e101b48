"""Binary decision trees over binned features, for boosting and for random forests.

Small learners for bounded training sets (the operators say how many rows they take); the
fitted models are arrays that every task evaluates with numpy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes as arrays: feature (-1: leaf), threshold (go left if value <= it), children, value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)


def _bins(x: np.ndarray, most: int = 32) -> list[np.ndarray]:
    """Cut points of each feature: quantiles, at most `most`."""
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > most:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most + 1)[1:]))
        cuts.append((values[:-1] + values[1:]) / 2 if len(values) > 1 else np.zeros(0))
    return cuts


def grow(x, gradient, hessian, depth, cuts, least=5.0, penalty=1.0, columns=None, draw=None) -> Tree:
    """A tree whose leaves are -sum(gradient) / (sum(hessian) + penalty).

    With gradient = -w * y and hessian = w, and no penalty, leaves are weighted means.
    columns: features tried at each node (all if None), drawn with `draw`.
    """
    nodes: list[list] = []

    def build(rows: np.ndarray, left: int) -> int:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, -g / (h + penalty) if h + penalty > 0 else 0.0])
        if left == 0 or h < 2 * least:
            return me
        best = (1e-9, None, None)
        tried = range(x.shape[1]) if columns is None else draw.choice(x.shape[1], columns, replace=False)
        for j in tried:
            if not len(cuts[j]):
                continue
            bin_ = np.searchsorted(cuts[j], x[rows, j], side="left")
            gs = np.bincount(bin_, gradient[rows], len(cuts[j]) + 1).cumsum()[:-1]
            hs = np.bincount(bin_, hessian[rows], len(cuts[j]) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + penalty + 1e-12) + (g - gs) ** 2 / (h - hs + penalty + 1e-12) - g**2 / (h + penalty + 1e-12)
            gain[(hs < least) | (h - hs < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, cuts[j][k])
        if best[1] is None:
            return me
        goes = x[rows, best[1]] <= best[2]
        a, b = build(rows[goes], left - 1), build(rows[~goes], left - 1)
        nodes[me][:4] = [best[1], best[2], a, b]
        return me

    build(np.arange(len(x)), depth)
    columns_ = list(zip(*nodes, strict=True))
    return Tree(np.array(columns_[0]), np.array(columns_[1], float), np.array(columns_[2]), np.array(columns_[3]), np.array(columns_[4], float))


@dataclass
class Boosted:
    """Gradient-boosted trees for the log-odds of label 1, with a calibration a + b * margin."""

    base: float = 0.0
    rate: float = 0.1
    trees: list[Tree] = field(default_factory=list)
    a: float = 0.0
    b: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * self.margin(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, held: np.ndarray | None = None) -> Boosted:
        """Fits on the rows that are not `held`, and calibrates on those that are."""
        held = np.zeros(len(y), bool) if held is None else held
        if held.all() or not held.any():
            held = np.zeros(len(y), bool)
        tx, ty = x[~held], y[~held]
        mean = np.clip(ty.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        cuts, margin = _bins(tx), np.full(len(ty), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = grow(tx, p - ty, p * (1 - p) + 1e-6, depth, cuts, least=1.0)
            self.trees.append(tree)
            margin += self.rate * tree.predict(tx)
        cx, cy = (x[held], y[held]) if held.any() else (tx, ty)
        m = self.margin(cx)
        for _ in range(50):  # Newton steps of the two calibration numbers, with smoothed labels
            p = 1 / (1 + np.exp(-np.clip(self.a + self.b * m, -30, 30)))
            target = (cy * (cy.sum() + 1) + (1 - cy) * 1) / np.where(cy == 1, cy.sum() + 2, len(cy) - cy.sum() + 2)
            w = p * (1 - p) + 1e-6
            g = np.array([(p - target).sum(), ((p - target) * m).sum()])
            hess = np.array([[w.sum(), (w * m).sum()], [(w * m).sum(), (w * m * m).sum() + 1e-6]])
            step = np.clip(np.linalg.solve(hess + 1e-6 * np.eye(2), g), -1, 1)
            self.a, self.b = self.a - step[0], self.b - step[1]
        return self


@dataclass
class Forest:
    """A random forest: mean of the trees' leaf means, each tree on a bootstrap sample."""

    trees: list[Tree] = field(default_factory=list)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(x))
        return sum((t.predict(x) for t in self.trees), np.zeros(len(x))) / len(self.trees)

    def fit(self, x: np.ndarray, y: np.ndarray, count: int = 50, depth: int = 8, seed: int = 5) -> Forest:
        draw, cuts = np.random.default_rng(seed), _bins(x)
        columns = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
        for _ in range(count):
            weight = np.bincount(draw.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
            self.trees.append(grow(x, -weight * y, weight, depth, cuts, least=1.0, penalty=0.0, columns=columns, draw=draw))
        return self

"""Histogram gradient-boosted trees for two classes, trained and evaluated with numpy.

Training rows are a bounded sample that the caller has collected; scoring is vectorised over all rows of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Trees flattened into arrays: a node is a leaf if ``left`` is its own index, so a walk of ``depth`` steps ends."""

    base: float = 0.0
    depth: int = 0
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, dtype=np.int32)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of class 1."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -35, 35)))


def _bins(column: np.ndarray, n_bins: int) -> np.ndarray:
    """Upper edges of at most ``n_bins`` bins of about equal weight, halfway between values."""
    values = np.unique(column)
    if len(values) > n_bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, n_bins)))
    return (values[1:] + values[:-1]) / 2


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, n_bins: int = 64,
          min_hessian: float = 2.0, ridge: float = 1.0) -> Trees:
    """Fit on rows ``x`` with classes ``y``. Without rows, or with one class only, the result is a constant."""
    if not len(y):
        return Trees()
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Trees(base=float(np.log(share / (1 - share))), depth=depth)
    if y.min() == y.max():
        return model
    edges = [_bins(x[:, j], n_bins) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    cells = binned + np.arange(x.shape[1]) * width
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    margin = np.full(len(y), model.base)

    def leaf(value: float) -> int:
        at = len(nodes["value"])
        for key, v in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", value)):
            nodes[key].append(v)
        return at

    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)

        def grow(rows: np.ndarray, level: int) -> int:
            g, h = gradient[rows].sum(), hessian[rows].sum()
            at = leaf(float(-rate * g / (h + ridge)))
            if level == depth or h < 2 * min_hessian:
                margin[rows] += nodes["value"][at]
                return at
            flat, n = cells[rows].ravel(), x.shape[1] * width
            gs = np.bincount(flat, np.repeat(gradient[rows], x.shape[1]), n).reshape(-1, width).cumsum(1)[:, :-1]
            hs = np.bincount(flat, np.repeat(hessian[rows], x.shape[1]), n).reshape(-1, width).cumsum(1)[:, :-1]
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            gain[(hs < min_hessian) | (h - hs < min_hessian)] = 0
            j, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, b] <= 1e-9 or b >= len(edges[j]):
                margin[rows] += nodes["value"][at]
                return at
            below = binned[rows, j] <= b
            nodes["feature"][at], nodes["threshold"][at] = int(j), float(edges[j][b])
            nodes["left"][at], nodes["right"][at] = grow(rows[below], level + 1), grow(rows[~below], level + 1)
            return at

        model.roots.append(grow(np.arange(len(y)), 0))
    model.feature, model.left, model.right = (np.array(nodes[k], dtype=np.int32) for k in ("feature", "left", "right"))
    model.threshold, model.value = np.array(nodes["threshold"]), np.array(nodes["value"])
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, steps: int = 50) -> Trees:
    """Fit slope and shift of the margin to rows that were not trained on (logistic, by Newton's method)."""
    if len(y) and y.min() != y.max():
        margin = model.margin(x)
        w = np.array([1.0, 0.0])
        design = np.stack([margin, np.ones(len(y))], axis=1)
        for _ in range(steps):
            p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -35, 35)))
            gradient = design.T @ (p - y) + 0.5 * (w - [1.0, 0.0])
            w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2), gradient)
        if w[0] > 0:
            model.slope, model.shift = float(w[0]), float(w[1])
    return model

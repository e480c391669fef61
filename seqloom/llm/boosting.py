"""Gradient-boosted trees for binary labels and isotonic calibration, in numpy.

For feature matrices of a bounded size (a labelled sample on the driver); prediction is vectorised
and runs inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of equal depth: node k has children 2k+1 and 2k+2."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; a row goes right if its value is above
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 5.0, ridge: float = 1.0
) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins."""
    n, m = x.shape
    prior = np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(prior / (1 - prior))), *(np.zeros((0, k)) for k in (2**depth - 1, 2**depth - 1, 2**depth)))
    if n < 2 or y.min() == y.max():
        model.feature = model.feature.astype(np.int64)
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(n, model.start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for k in range(2**depth - 1):
            rows = np.flatnonzero(node == k)
            if len(rows) > 1:
                gain, feature[k], threshold[k] = _best_split(binned[rows], g[rows], h[rows], cuts, bins, least, ridge)
                if gain <= 1e-9:
                    threshold[k] = np.inf
            node[rows] = 2 * k + 1 + (x[rows, feature[k]] > threshold[k])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(model.start, np.array(features), np.array(thresholds), np.array(leaves))


def _best_split(binned, g, h, cuts, bins, least, ridge):
    best = (0.0, 0, np.inf)
    total_g, total_h = g.sum(), h.sum()
    parent = total_g**2 / (total_h + ridge)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        left_g = np.cumsum(np.bincount(binned[:, j], g, bins))[: len(c)]
        left_h = np.cumsum(np.bincount(binned[:, j], h, bins))[: len(c)]
        right_g, right_h = total_g - left_g, total_h - left_h
        count = np.cumsum(np.bincount(binned[:, j], minlength=bins))[: len(c)]
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - parent
        gain[(count < least) | (len(g) - count < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(c[k]))
    return best


@dataclass
class Isotonic:
    """A monotone map from margins to probabilities, linear between its knots."""

    knots: np.ndarray
    values: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.knots, self.values)


def fit_isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
    """Pool adjacent violators; each pooled block is shrunk towards the mean by ``prior`` rows."""
    if not len(y):
        return Isotonic(np.array([0.0]), np.array([0.5]))
    order = np.argsort(margin, kind="stable")
    mean = y.mean()
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    s, n, m = np.array(blocks).T
    knots, values = m / n, (s + prior * mean) / (n + prior)
    return Isotonic(knots, np.maximum.accumulate(values))


def cross_margins(x: np.ndarray, y: np.ndarray, fold: np.ndarray, **options) -> np.ndarray:
    """Margins of each row from trees that did not see its fold, for calibration."""
    out = np.zeros(len(y))
    for k in np.unique(fold):
        rest = fold != k
        out[~rest] = fit_trees(x[rest], y[rest], **options).margin(x[~rest])
    return out

"""Histogram gradient-boosted trees for two classes, and their flat arrays for numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, BINS, RATE, L2 = 60, 4, 64, 0.15, 1.0


@dataclass
class Forest:
    """Complete trees side by side: node k of a tree has children 2k+1 and 2k+2; the last level are leaves."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row: all rows step down all trees together, level by level."""
        total = np.full(len(x), self.start)
        trees, inner = self.feature.shape
        which = np.arange(trees)[None, :]
        for i in range(0, len(x), 8192):
            part = x[i : i + 8192]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            while trees and node[0, 0] < inner:
                node = 2 * node + 1 + (part[rows, self.feature[which, node]] > self.threshold[which, node])
            if trees:
                total[i : i + 8192] += self.leaf[which, node - inner].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: float = 5.0) -> Forest:
    """Boosts depth-wise trees on binned features by gradients of the logistic loss.

    With no rows the score is 0.5 everywhere, and with one class the smoothed share of it.
    """
    p = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(p / (1 - p)))
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    cell = np.arange(width) * bins + binned
    raw = np.full(n, start)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * (width * bins) + cell).ravel()
            sg, sh = (np.bincount(flat, weights=np.repeat(v, width), minlength=many * width * bins).reshape(many, width, bins).cumsum(2) for v in (g, h))
            ag, ah = sg[:, :1, -1:], sh[:, :1, -1:]
            gain = sg**2 / (sh + L2) + (ag - sg) ** 2 / (ah - sh + L2) - ag**2 / (ah + L2)
            gain[(sh < least * 0.05) | (ah - sh < least * 0.05)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + L2)
        raw += leaf[t, at]
    return Forest(feature, threshold, leaf, start)

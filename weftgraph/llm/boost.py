"""Gradient-boosted oblivious trees for logistic loss, in numpy.

Every level of a tree asks one question of all its nodes, so a leaf is a bit pattern:
prediction is vectorised over rows, or written as DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    base: float
    #: (feature, threshold) by level, and 2^depth leaf values, of each tree.
    trees: list[tuple[list[tuple[int, float]], np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for splits, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for level, (f, t) in enumerate(splits):
                at |= (x[:, f] > t).astype(np.int64) << level
            out += leaves[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 1.0) -> Boosted:
    """Newton boosting on quantile bins; x is (rows, features), y holds 0 and 1."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(p / (1 - p))), [])
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at, splits = np.zeros(len(y), np.int64), []
        for level in range(depth):
            best = (-1.0, None)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                cell = at * width + binned[:, f]
                sums = [np.bincount(cell, w, width << level).reshape(-1, width) for w in (g, h)]
                left = [np.cumsum(s, axis=1)[:, :-1] for s in sums]
                right = [s.sum(axis=1, keepdims=True) - k for s, k in zip(sums, left, strict=True)]
                gain = (left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2)).sum(axis=0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
            if best[1] is None:
                break
            f, k = best[1]
            splits.append((f, float(cuts[f][k])))
            at |= (binned[:, f] > k).astype(np.int64) << level
        n = 1 << len(splits)
        leaves = rate * np.bincount(at, g, n) / (np.bincount(at, h, n) + l2)
        model.trees.append((splits, leaves))
        margin += leaves[at]
    return model


def threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score at and above which the held-out precision is reached (1.0 if nowhere)."""
    order = np.argsort(-probability, kind="stable")
    right = np.cumsum(np.asarray(y)[order]) / np.arange(1, len(y) + 1)
    last = np.append(np.diff(probability[order]) != 0, True)
    good = np.flatnonzero((right >= precision) & last)
    return float(probability[order][good[-1]]) if len(good) else 1.0

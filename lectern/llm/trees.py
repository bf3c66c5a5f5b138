"""Gradient-boosted trees for a few dozen columns, as flat node arrays, with monotonic constraints.

Defined cases: no rows, or labels of one kind only: the forest gives the base rate (an even one without rows); equal values
are never parted; not-a-number isn't expected in a column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in four arrays. Node i goes left if x[feature[i]] <= threshold[i]; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of ``x``: every row walks all trees at once, a level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(left, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: int = 10) -> Forest:
    """Log-loss boosting on binned columns. monotone: 1, -1 or 0 by column (score may only rise, fall, or anything).

    A split on a constrained column is refused where its two leaf values are in the wrong order, and each
    child is held beyond the middle of the two, so that no later split can undo the order. With rows of one
    label only, or none, the forest is a constant.
    """
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(m)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)]) if n else np.empty((0, m), int)
    raw = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(feature)
        feature.append(0), threshold.append(0.0), left.append(i), right.append(i), value.append(v)
        return i

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, more: int) -> int:
        best_v = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        i = node(best_v * rate)
        best = None
        if more and len(rows) >= 2 * least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j in range(m):
                if not len(cuts[j]):
                    continue
                b = binned[rows, j]
                gs, hs, ns = (np.bincount(b, w, len(cuts[j]) + 1).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                va, vb = (np.clip(-a / (c + l2), low, high) for a, c in ((gs, hs), (total_g - gs, total_h - hs)))
                gain = gs**2 / (hs + l2) + (total_g - gs) ** 2 / (total_h - hs + l2) - total_g**2 / (total_h + l2)
                ok = (ns >= least) & (len(rows) - ns >= least) & (monotone[j] * (vb - va) >= 0)
                gain = np.where(ok, gain, 0)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, (va[k] + vb[k]) / 2)
        if best:
            _, j, k, mid = best
            go = binned[rows, j] <= k
            bound = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[j])]
            a, b = grow(rows[go], g, h, *bound[0], more - 1), grow(rows[~go], g, h, *bound[1], more - 1)
            feature[i], threshold[i], left[i], right[i], value[i] = j, float(cuts[j][k]), a, b, 0.0
        return i

    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            start = len(feature)
            roots.append(grow(np.arange(n), p - y, p * (1 - p), -np.inf, np.inf, depth))
            tree = Forest(*map(np.array, (feature, threshold, left, right, value)), np.array([start]), depth, 0.0)
            got = tree.score(x)
            raw += np.log(got / (1 - got))
    else:
        roots.append(node(0.0))
    return Forest(*map(np.array, (feature, threshold, left, right, value)), np.array(roots), depth, base)

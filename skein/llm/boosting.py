"""Gradient-boosted trees in numpy, scored from flat node arrays.

Training is histogram-based with logistic loss; a feature may be constrained to act
monotonically (+1 or -1): a split that would break the order is refused, and the bounds
that a split sets are handed down to both children, so the whole sum is monotone.
Missing values take part as the value 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees: node i splits ``feature[i] <= threshold[i]`` to ``left[i]``, else ``right[i]``; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Fit a forest to rows ``x`` and labels ``y`` (0 or 1); with fewer than two labels it is a constant."""
    n, width = x.shape if len(x) else (0, len(monotone))
    rate_1 = (float(y.sum()) + 0.5) / (n + 1) if n else 0.5
    nodes: list[list[float]] = []
    roots: list[int] = []
    base = float(np.log(rate_1 / (1 - rate_1)))
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            out = np.zeros(n)

            def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
                g, h = grad[rows].sum(), hess[rows].sum()
                at = len(nodes)
                nodes.append([0, np.inf, at, at, 0.0])
                best = (1e-6, -1, 0, 0.0, 0.0)
                for f in range(width if level < depth else 0):
                    k = len(edges[f])
                    if not k:
                        continue
                    gl = np.cumsum(np.bincount(binned[f, rows], grad[rows], k + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[f, rows], hess[rows], k + 1))[:-1]
                    wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-(g - gl) / (h - hl + l2), low, high)
                    gain = -(gl * wl + (hl + l2) * wl**2 / 2) - ((g - gl) * wr + (h - hl + l2) * wr**2 / 2)
                    gain -= -(g * (w := np.clip(-g / (h + l2), low, high)) + (h + l2) * w**2 / 2)
                    gain[(hl < least) | (h - hl < least) | (monotone[f] * (wr - wl) < 0)] = -1
                    if gain[b := int(gain.argmax())] > best[0]:
                        best = (float(gain[b]), f, b, float(wl[b]), float(wr[b]))
                if best[1] < 0:
                    nodes[at][4] = rate * float(np.clip(-g / (h + l2), low, high))
                    out[rows] = nodes[at][4]
                    return at
                _, f, b, wl, wr = best
                goes = binned[f, rows] <= b
                middle = (wl + wr) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(monotone[f], ((low, high), (low, high)))
                nodes[at][:2] = [f, float(edges[f][b])]
                nodes[at][2] = grow(rows[goes], level + 1, *bounds[0])
                nodes[at][3] = grow(rows[~goes], level + 1, *bounds[1])
                return at

            roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
            margin += out
    flat = np.array(nodes, float).reshape(-1, 5)
    return Forest(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, int), base, depth)

"""Histogram gradient-boosted trees for a yes-no label, in numpy, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in flat arrays; an inner node's children stand side by side, a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values; every row goes down all trees one level at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                inner = self.left[node] != node
                node = self.left[node] + (inner & (x[rows, self.feature[node]] > self.threshold[node]))
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 3.0) -> Trees:
    """Logistic loss, second-order gains, quantile bins; least is the least sum of second derivatives in a child.

    Deterministic. Without rows, or with one label only, the result is the prior alone, held within 0.02 and 0.98.
    """
    n, m = x.shape
    prior = (y.sum() + 1) / (n + 2)
    base = float(np.log(prior / (1 - prior)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n == 0 or y.min() == y.max():
        base = float(np.clip(base, -3.9, 3.9))
        trees = 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for j in range(m)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1) if n else np.zeros((0, m), int)
    raw = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        level, where = [(len(feature), np.arange(n))], {}
        feature.append(0), threshold.append(0.0), left.append(len(feature) - 1), value.append(0.0)
        for d in range(depth + 1):
            below = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = float(-rate * gs / (hs + l2))
                where[node] = rows
                if d == depth or len(rows) < 2:
                    continue
                best = (1e-6, 0, 0)
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    gl = np.cumsum(np.bincount(code[rows, j], g[rows], len(edges[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, j], h[rows], len(edges[j]) + 1))[:-1]
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(hl < least) | (hs - hl < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
                if best[0] <= 1e-6:
                    continue
                _, j, k = best
                right = code[rows, j] > k
                feature[node], threshold[node], left[node] = j, float(edges[j][k]), len(feature)
                del where[node]
                for some in (rows[~right], rows[right]):
                    below.append((len(feature), some))
                    feature.append(0), threshold.append(0.0), left.append(len(feature) - 1), value.append(0.0)
            level = below
        for node, rows in where.items():
            raw[rows] += value[node]
    return Trees(np.array(feature or [0]), np.array(threshold or [0.0]), np.array(left or [0]), np.array(value or [0.0]), np.array(roots, int), base, depth)

"""Gradient-boosted trees on histograms: logistic loss, complete trees of fixed depth."""

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float
    depth: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.35, bins: int = 32, ridge: float = 1.0, weight: np.ndarray | None = None, columns: float = 0.35, seed: int = 0) -> Trees:
    """``columns``: share of the features that each tree may use, so that the score leans on all that tell."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    w = np.ones(n) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    offset = np.arange(d) * bins
    mean = np.average(y, weights=w)
    start = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    z = np.full(n, start)
    features, thresholds, leaves = [], [], []
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = (y - p) * w, p * (1 - p) * w
        barred = np.flatnonzero(rng.random(d) >= columns)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (d * bins) + offset + binned).ravel()
            gs, hs = (np.bincount(cell, np.repeat(v, d), count * d * bins).reshape(count, d, bins).cumsum(2) for v in (g, h))
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            gain[:, barred] = -1
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                if gain[k].ravel()[best[k]] > 1e-6:
                    f[first + k], t[first + k] = best[k] // bins, edges[best[k] // bins][best[k] % bins]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = rate * np.bincount(at - inner, g, 2**depth) / (np.bincount(at - inner, h, 2**depth) + ridge)
        z += leaf[at - inner]
        features.append(f)
        thresholds.append(t)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start, depth)

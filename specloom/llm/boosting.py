"""Gradient-boosted trees over histograms, flattened into arrays.

Numbers fall into bins at quantiles of the training rows. Every tree is grown level by level from
histograms of gradients, as a complete binary tree of one depth; the children of node i are 2i + 1 and
2i + 2, so a forest is three flat arrays. Rows walk all trees at once: one array operation per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """split feature and threshold by (tree, inner node), value by (tree, leaf), all flat; prior: log odds."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    trees: int
    depth: int
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of the positive class of each row."""
        inner, leaves = 2**self.depth - 1, 2**self.depth
        n = len(rows)
        node = np.zeros((n, self.trees), np.int64)
        base = np.arange(self.trees) * inner
        flat, start = rows.ravel(), (np.arange(n) * rows.shape[1])[:, None]
        for _ in range(self.depth):
            at = base + node
            node = 2 * node + 1 + (flat[start + self.feature[at]] > self.threshold[at])
        total = self.prior + self.value[np.arange(self.trees) * leaves + node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


@dataclass(frozen=True)
class Settings:
    trees: int = 80
    depth: int = 5
    bins: int = 64
    rate: float = 0.15
    penalty: float = 1.0
    least_weight: float = 2.0  # of a leaf, in second derivatives


def binned(rows: np.ndarray, bins: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Edges of each column at its quantiles, and the bin of each number: those above so many edges."""
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(rows.shape[1])]
    return edges, np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)


def fit(rows: np.ndarray, positive: np.ndarray, weights: np.ndarray, settings: Settings = Settings()) -> Forest:
    """A forest from rows of numbers, whether each is positive, and how much it counts.

    Without rows the score is one half, with one class all rows get a score near it.
    """
    s = settings
    inner, leaves = 2**s.depth - 1, 2**s.depth
    yes, no = float(weights[positive].sum()), float(weights[~positive].sum())
    prior = float(np.log((yes + 1) / (no + 1)))
    if not yes or not no:
        return Forest(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0, s.depth, prior)
    edges, bins = binned(rows, s.bins)
    n, columns = bins.shape
    place = np.arange(columns) * s.bins + bins
    features, thresholds, values = [], [], []
    score = np.full(n, prior)
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-score))
        gradient, second = weights * (p - positive), weights * p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(s.depth):
            first, wide = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (columns * s.bins) + place).ravel()
            shape = (wide, columns, s.bins)
            g, h = (np.bincount(at, np.repeat(x, columns), wide * columns * s.bins).reshape(shape) for x in (gradient, second))
            gl, hl = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
            gs, hs = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
            gr, hr = gs - gl, hs - hl
            gain = gl**2 / (hl + s.penalty) + gr**2 / (hr + s.penalty) - gs**2 / (hs + s.penalty)
            gain = np.where((hl >= s.least_weight) & (hr >= s.least_weight), gain, -np.inf).reshape(wide, -1)
            best = gain.argmax(1)
            f, b = np.divmod(best, s.bins - 1)
            split = gain[np.arange(wide), best] > 1e-9
            cut = np.full(wide, s.bins)
            for i in np.flatnonzero(split):
                feature[first + i], cut[i] = f[i], b[i]
                threshold[first + i] = edges[f[i]][b[i]] if b[i] < len(edges[f[i]]) else np.inf
            mine = node - first
            node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > cut[mine])
        leaf = node - inner
        value = -s.rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, second, leaves) + s.penalty)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.concatenate(features), np.concatenate(thresholds), np.concatenate(values), s.trees, s.depth, prior)

"""Histogram gradient-boosted trees, flattened into arrays for numpy."""

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees of one depth, level by level, as rows of four arrays.

    Node k of a tree has the children 2k+1 and 2k+2. A node that was not split sends all rows
    left. `value` holds a number for each leaf, `base` the log-odds of the whole sample.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """Of label 1, for a matrix of rows by features; all rows go down a level at once."""
        total = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(rows), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (rows[at, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def train(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    smooth: float = 2.0,
    least: int = 5,
) -> Forest:
    """Logistic loss, `bins` quantile bins per feature, `depth` levels of splits.

    A split needs `least` rows on each side; `smooth` is added to the Hessian of a leaf.
    Without rows the probability is 0.5 for all, with one label near that label.
    """
    count, width = rows.shape
    inner, leaves = 2**depth - 1, 2**depth
    features = np.zeros((trees, inner), np.int64)
    limits = np.full((trees, inner), np.inf)
    values = np.zeros((trees, leaves))
    share = (labels.sum() + 0.5) / (count + 1)
    base = float(np.log(share / (1 - share)))
    if not count or labels.min() == labels.max():
        return Forest(features, limits, values, base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, rows.T)], 1)
    flat = binned + np.arange(width) * bins
    total = np.full(count, base)
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = labels - chance, chance * (1 - chance)
        node = np.zeros(count, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (wide, width, bins)
            sums = [
                np.bincount(cell, np.repeat(w, width), wide * width * bins).reshape(shape)
                for w in (slope, bend, np.ones(count))
            ]
            left = [s.cumsum(2)[:, :, :-1] for s in sums]
            whole = [s.sum(2, keepdims=True) for s in sums]
            right = [w - s for w, s in zip(whole, left)]
            gain = (
                left[0] ** 2 / (left[1] + smooth)
                + right[0] ** 2 / (right[1] + smooth)
                - whole[0] ** 2 / (whole[1] + smooth)
            )
            gain[(left[2] < least) | (right[2] < least)] = -1
            best = gain.reshape(wide, -1).argmax(1)
            for k in range(wide):
                f, b = divmod(int(best[k]), bins - 1)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    features[tree, first + k], limits[tree, first + k] = f, edges[f][b]
            chosen, limit = features[tree, node], limits[tree, node]
            node = 2 * node + 1 + (rows[np.arange(count), chosen] > limit)
        leaf = node - inner
        up = np.bincount(leaf, slope, leaves) / (np.bincount(leaf, bend, leaves) + smooth)
        values[tree] = rate * up
        total += values[tree][leaf]
    return Forest(features, limits, values, base)

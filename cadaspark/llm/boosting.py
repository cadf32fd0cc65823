"""Gradient-boosted trees on feature histograms, small enough to be trained on a bounded sample in the driver.

Trees are complete binary trees of one depth, flattened into arrays [tree, node]: a row's place is moved down one level for all
trees at once, so scoring is a few numpy operations per level for any number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """``feature`` and ``threshold`` by [tree, inner node], ``value`` by [tree, leaf]; ``base`` is the log odds to start from."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            rows = np.arange(len(part))[:, None]
            place = np.zeros((len(part), len(self.feature)), dtype=np.int64)
            for _ in range(self.depth):
                right = part[rows, self.feature[trees, place]] > self.threshold[trees, place]
                place = 2 * place + 1 + right
            out[start : start + 4096] += self.value[trees, place - (2**self.depth - 1)].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts between quantiles, per feature; a cut is halfway between two values that occur."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        edges.append((values[1:] + values[:-1]) / 2)
    return edges


def train(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
    ridge: float = 1.0, least: int = 8,
) -> Forest:
    """Logistic loss, second order; a node is split at the best histogram cut or sends everything left."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    if len(y) == 0 or x.shape[1] == 0:
        return Forest(feature[:0], threshold[:0], value[:0], base, depth)
    edges = bin_edges(x, bins)
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    width = max(len(e) for e in edges) + 1
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, np.maximum(p * (1 - p), 1e-9)
        place = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            node = place - first
            best = np.full(nodes, 1e-9)
            chosen = np.zeros(nodes, dtype=np.int64)
            cut = np.full(nodes, -1)
            for f, edge in enumerate(edges):
                if len(edge) == 0:
                    continue
                cell = node * width + binned[:, f]
                g = np.bincount(cell, slope, nodes * width).reshape(nodes, width).cumsum(axis=1)
                h = np.bincount(cell, bend, nodes * width).reshape(nodes, width).cumsum(axis=1)
                n = np.bincount(cell, minlength=nodes * width).reshape(nodes, width).cumsum(axis=1)
                all_g, all_h, all_n = g[:, -1:], h[:, -1:], n[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(n < least) | (all_n - n < least)] = 0
                gain = gain[:, : len(edge)]
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                better = top > best
                best[better], chosen[better], cut[better] = top[better], f, at[better]
            for k in range(nodes):
                if cut[k] >= 0:
                    feature[t, first + k] = chosen[k]
                    threshold[t, first + k] = edges[chosen[k]][cut[k]]
            right = (cut[node] >= 0) & (binned[np.arange(len(y)), chosen[node]] > cut[node])
            place = 2 * place + 1 + right
        leaf = place - inner
        value[t] = rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, bend, leaves) + ridge)
        margin += value[t][leaf]
    return Forest(feature, threshold, value, base, depth)

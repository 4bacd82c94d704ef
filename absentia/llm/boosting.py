"""Gradient-boosted trees for a bounded table of numbers: logistic loss, binned splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Tree:
    """A full binary tree by levels: children of node i are 2 i + 1 and 2 i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.cut[at])
        return self.value[at - (2**self.depth - 1)]


def _tree(x, binned, edges, slope, curve, depth: int, rate: float, ridge: float) -> Tree:
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(x), np.int64)
    for level in range(depth):
        base = 2**level - 1
        width = 2**level
        local = at - base
        best = np.full(width, 1e-9)
        for f in range(x.shape[1]):
            key = local * BINS + binned[:, f]
            g = np.bincount(key, slope, width * BINS).reshape(width, BINS).cumsum(axis=1)
            h = np.bincount(key, curve, width * BINS).reshape(width, BINS).cumsum(axis=1)
            all_g, all_h = g[:, -1:], h[:, -1:]
            gain = (
                g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge)
                - all_g**2 / (all_h + ridge)
            )[:, : len(edges[f])]
            if not gain.shape[1]:
                continue
            pick = gain.argmax(axis=1)
            top = gain[np.arange(width), pick]
            for n in np.flatnonzero(top > best):
                best[n], feature[base + n], cut[base + n] = top[n], f, edges[f][pick[n]]
        at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
    leaf = at - inner
    g = np.bincount(leaf, slope, inner + 1)
    h = np.bincount(leaf, curve, inner + 1)
    return Tree(feature, cut, -rate * g / (h + ridge), depth)


@dataclass
class Boosted:
    base: float
    trees: list[Tree]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def boost(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3,
    ridge: float = 1.0,
) -> Boosted:
    """Newton boosting. Without rows of both kinds it is a constant."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(p / (1 - p))), [])
    if not 0 < y.sum() < len(y):
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    odds = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        tree = _tree(x, binned, edges, p - y, p * (1 - p), depth, rate, ridge)
        model.trees.append(tree)
        odds += tree.predict(x)
    return model

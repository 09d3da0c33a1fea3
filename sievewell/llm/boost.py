"""Gradient-boosted trees for a few classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray  # the same; values up to it go left
    leaf: np.ndarray  # (trees, 2**depth)
    classes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities (rows, classes)."""
        out = np.zeros((len(x), self.classes))
        rows = np.arange(len(x))
        for i in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                at = 2 * at + 1 + (x[rows, self.feature[i][at]] > self.cut[i][at])
            out[:, i % self.classes] += self.leaf[i][at - self.feature.shape[1]]
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 25, depth: int = 4, rate: float = 0.3, bins: int = 32, smooth: float = 2.0) -> Trees:
    """Boosting by Newton's steps on the softmax loss."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    flat = binned + np.arange(m) * bins
    f = np.zeros((n, classes))
    features, cuts, leaves = [], [], []
    for i in range(rounds * classes):
        k = i % classes
        p = np.exp(f - f.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True))[:, k]
        g, h = p - (y == k), np.maximum(p * (1 - p), 1e-6)
        at, feature, cut = np.zeros(n, np.int64), np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        split = np.full(2**depth - 1, bins)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((at - first)[:, None] * (m * bins) + flat).ravel()
            sums = [np.cumsum(np.bincount(key, np.repeat(w, m), width * m * bins).reshape(width, m, bins), axis=2) for w in (g, h)]
            (gl, hl), (ga, ha) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
            best = gain.reshape(width, -1).argmax(axis=1)
            for v in range(width):
                j, b = divmod(int(best[v]), bins)
                if gain[v, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + v], split[first + v], cut[first + v] = j, b, edges[j][b]
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > split[at])
        at -= 2**depth - 1
        leaf = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + smooth)
        f[:, k] += leaf[at]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), classes)

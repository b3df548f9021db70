"""Gradient-boosted regression trees for two classes, over binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Trees of equal depth: for each the features and thresholds of its inner nodes, level by level, and its leaves."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)])
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(n, base)
    inner = (1 << depth) - 1
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            best = np.zeros(many)
            local = at - first
            for f in range(width):
                if not len(cuts[f]):
                    continue
                code = local * (bins + 1) + binned[f]
                gs = np.bincount(code, g, many * (bins + 1)).reshape(many, -1).cumsum(axis=1)
                hs = np.bincount(code, h, many * (bins + 1)).reshape(many, -1).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, : len(cuts[f])], hs[:, : len(cuts[f])], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                k = gain.argmax(axis=1)
                top = gain[np.arange(many), k]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[first : first + many][better] = f
                threshold[first : first + many][better] = cuts[f][k[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)

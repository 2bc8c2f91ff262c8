"""Gradient-boosted trees on binned dense features, and isotonic regression, in numpy."""

from __future__ import annotations

import numpy as np

from millrace.llm.training import sigmoid

BINS = 64


class Trees:
    """Complete trees of one depth: arrays of split features, thresholds and leaf values."""

    def __init__(self, depth: int, rate: float, start: float):
        self.depth, self.rate, self.start = depth, rate, start
        self.feature = np.zeros((0, (1 << depth) - 1), np.int16)
        self.threshold = np.zeros((0, (1 << depth) - 1))
        self.leaf = np.zeros((0, 1 << depth))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += self.rate * leaf[node - len(feature)]
        return out


def cut_points(column: np.ndarray) -> np.ndarray:
    values = np.unique(column)
    if len(values) <= BINS:
        return (values[:-1] + values[1:]) / 2
    return np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Logistic loss; each split is the best gain over all bins; a leaf needs `least` of curvature."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees = Trees(depth, rate, float(np.log(share / (1 - share))))
    cuts = [cut_points(x[:, j]) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), trees.start)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = sigmoid(margin)
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros((1 << depth) - 1, np.int16), np.full((1 << depth) - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, width = (1 << level) - 1, 1 << level
            gain = np.full(width, 1e-6)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - base) * (len(c) + 1) + binned[:, j]
                gs = np.bincount(key, g, width * (len(c) + 1)).reshape(width, -1)
                hs = np.bincount(key, h, width * (len(c) + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                score = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                score[(hl < least) | (ha - hl < least)] = 0
                best = score.argmax(1)
                better = np.flatnonzero(score[np.arange(width), best] > gain)
                gain[better] = score[better, best[better]]
                feature[base + better], threshold[base + better] = j, c[best[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        node -= len(feature)
        leaf = -np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
        margin += rate * leaf[node]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    trees.feature, trees.threshold, trees.leaf = np.array(features), np.array(thresholds), np.array(leaves)
    return trees


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y over x by pooling adjacent violators; equal x are one point."""
    values, where = np.unique(x, return_inverse=True)
    weight = np.bincount(where).astype(float)
    mean = np.bincount(where, y) / weight
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for m, w, v in zip(mean, weight, values, strict=True):
        blocks.append([m, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])

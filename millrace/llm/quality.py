"""Quality scores by naive Bayes support vectors.

Each text gives binary indicators: hashed words and word pairs (case kept), hashed byte
trigrams, and a few shapes (how much words repeat, by length).  Indicators are scaled by the
log-count ratio of the classes, and a linear hinge-loss model is fitted over them by dual
coordinate descent.  A logistic curve over margins of rows that the model has not seen turns
margins into scores.

The sample of labelled rows is bounded by `sample_rows`; all rows are scored, over their whole
texts, however long, a slice at a time.  Repeated rows get equal scores; repeated labels of an id
count once.  Null and empty texts get the score of a text without indicators; without labels of both
classes the score is the share of class 1 (0.5 without any).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import NONSPACE, Words, read_table, text_slices
from millrace.llm.training import fit_in_one_task, labelled_sample, score_rows, sigmoid

SAMPLE_ROWS = 8000
THRESHOLD = 0.7
WORD_BITS, BYTE_BITS = 18, 16
PAIR_AT = 1 << WORD_BITS
BYTE_AT = 2 << WORD_BITS
SHAPE_AT = BYTE_AT + (1 << BYTE_BITS)
SIZE = SHAPE_AT + 1024
SMOOTHING = 1.0
#: the bound on each row's weight in the dual
COST = 1.0
EPOCHS = 12
#: the part of the sample that the logistic curve is fitted on: one row in so many
CURVE_ROWS = 5


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted numbers of the indicators of each text."""
    flags = np.zeros(SHAPE_AT, bool)
    for a, b, data, offsets in text_slices(texts):
        words = Words(data, offsets, NONSPACE, fold=False)
        down = np.uint64(64 - WORD_BITS)
        single = (words.hash >> down).astype(np.int64)
        at, pair = words.grams(2)
        pair = (pair >> down).astype(np.int64) + PAIR_AT
        pair_first = np.searchsorted(at, words.first)
        wide = data.astype(np.uint32)
        three = ((wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BYTE_BITS)
        three = three.astype(np.int64) + BYTE_AT
        again = np.concatenate(([0], np.cumsum(words.hash[1:] == words.hash[:-1]))) if len(words.hash) else np.zeros(1, np.int64)
        for i in range(b - a):
            w0, w1, c0, c1 = int(words.first[i]), int(words.first[i + 1]), int(offsets[i]), int(offsets[i + 1])
            flags[single[w0:w1]] = True
            distinct = int(np.count_nonzero(flags[:PAIR_AT]))
            flags[pair[pair_first[i] : pair_first[i + 1]]] = True
            flags[three[c0 : max(c0, c1 - 2)]] = True
            on = np.flatnonzero(flags)
            flags[on] = False
            n = w1 - w0
            length = min(15, n.bit_length())
            shapes = [length]
            if n > 1:
                repeats = int(again[w1 - 1] - again[w0]) / n
                shapes += [16 + length * 16 + int(15 * distinct / n), 512 + int(15 * repeats)]
            yield np.concatenate((on, np.array(shapes) + SHAPE_AT))


def fit(texts: pa.Array, y: np.ndarray, ids: np.ndarray) -> bytes:
    """Scaled weights, bias, and the two numbers of the logistic curve, saved as arrays."""
    rows = [x.astype(np.int32) for x in indicators(texts)]
    prior = float(y.mean())
    if prior in (0.0, 1.0):
        return _save(np.zeros(0, np.float32), np.array([0.0, 0.0, prior]))
    sign = np.where(y == 1, 1.0, -1.0)
    curve = np.arange(len(y)) % CURVE_ROWS == 0
    if len(set(y[curve])) < 2 or len(set(y[~curve])) < 2:
        curve[:] = False
    # neither ratios nor weights of this model have seen the rows of the curve
    use = np.flatnonzero(~curve)
    w, bias = _descend(rows, sign, _ratios(rows, y, use), use)
    on = np.flatnonzero(curve) if curve.any() else np.arange(len(y))
    margin = np.array([w[rows[i]].sum() + bias for i in on])
    slope, shift = _logistic(margin, y[on].astype(float))
    if curve.any():
        use = np.arange(len(y))
        w, bias = _descend(rows, sign, _ratios(rows, y, use), use)
    return _save(w.astype(np.float32), np.array([bias, slope, shift]))


def _ratios(rows: list[np.ndarray], y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The log-count ratio of each indicator over the rows in use."""
    counts = np.full((2, SIZE), SMOOTHING)
    for i in use.tolist():
        counts[y[i]][rows[i]] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def _save(weights: np.ndarray, numbers: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, weights=weights, numbers=numbers)
    return out.getvalue()


def _descend(rows: list[np.ndarray], sign: np.ndarray, ratio: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; each row has unit norm.  Weights come back scaled to plain indicators."""
    norm = {i: float(np.square(ratio[rows[i]]).sum()) + 1.0 for i in use.tolist()}
    weights, bias = np.zeros(len(ratio)), 0.0  # over indicators times ratio, so that w.x is a gather and a sum
    alpha = np.zeros(len(sign))
    square = np.square(ratio)
    random = np.random.default_rng(3)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in random.permutation(use).tolist():
            x, scale = rows[i], norm[i] ** -0.5
            gradient = sign[i] * scale * (weights[x].sum() + bias) - 1
            new = min(max(alpha[i] - gradient, 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i] * scale
                weights[x] += step * square[x]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, over targets drawn in from 0 and 1."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(np.abs(margin).mean()) or 1.0
    x = np.stack((margin / scale, np.ones_like(margin)), axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ beta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-6])
        beta -= np.linalg.solve(hessian, x.T @ (p - target) + np.array([1e-4, 0]) * beta)
    return float(beta[0] / scale), float(beta[1])


def scorer(model: bytes | None):
    """A function from texts to scores."""
    if model is None:
        return lambda texts: np.full(len(texts), 0.5)
    saved = np.load(io.BytesIO(model))
    weights, (bias, slope, shift) = saved["weights"], saved["numbers"]
    if not len(weights):
        return lambda texts: np.full(len(texts), shift)

    def run(texts: pa.Array) -> np.ndarray:
        margin = np.fromiter((weights[x].sum(dtype=np.float64) for x in indicators(texts)), np.float64, len(texts))
        return sigmoid(slope * (margin + bias) + shift)

    return run


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label: str = "quality") -> bytes | None:
    return fit_in_one_task(labelled_sample(docs, labels, label, sample_rows), fit)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score_rows(docs, scorer(train(docs, labels, sample_rows)), THRESHOLD)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

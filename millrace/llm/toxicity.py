"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of a lexicon, how near its hits stand to second-person
words, and rates of capitals, punctuation and obfuscated words.  The lexicon has a few seeds and
what the labelled sample adds: words and word beginnings (hashed) whose documents are far more
often toxic than others.  For the rows that the trees are fitted on, the lexicon is learned
without the row's own fold, so it means the same for them as for new rows.

The sample of labelled rows is bounded by `sample_rows`, and the learned lexicon by
LEXICON_ENTRIES, its strongest units; all rows are scored over their whole texts, however long.
Repeated rows get equal scores; repeated labels of an id count once.  Null and empty texts have all features zero.  Without labels of both classes the score
is the share of class 1 (0.5 without any).
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.boost import Trees, boost, isotonic
from millrace.llm.common import BYTE_VALUE, FOLD, NONSPACE, Words, as_bytes, prefix, read_table, spans, text_slices
from millrace.llm.training import fit_in_one_task, labelled_sample, score_rows, sigmoid

SAMPLE_ROWS = 8000
THRESHOLD = 0.3
FOLDS = 4
#: lengths in bytes of word beginnings; 0 is the whole word
BEGINNINGS = (0, 4, 5, 6, 7, 8, 9, 10)
LEXICON_ENTRIES = 20_000
NEAR_WORDS = 5
_FILTER_BITS = 20
#: units are hashes of 48 bits, so that a unit and a row of a slice fit into 64
KEY = np.uint64((1 << 64) - (1 << 16))
WHOLE = 0x5555555555555555

# Seeds of the lexicon, and second-person words of four languages.
SEEDS = "clown disgusting dumb hate idiot kill loser moron pathetic scum shut stupid trash ugly worthless".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()

FEATURES = ("hits", "hit_share", "weight", "weight_share", "top_weight", "distinct", "seeds", "seed_share", "near_you", "near_share", "you_share", "capitals", "punctuation", "obfuscated", "shouting", "length")


def hashes_of(words: list[str]) -> np.ndarray:
    return np.unique((Words(*as_bytes(pa.array(words)), NONSPACE).hash ^ np.uint64(WHOLE)) & KEY)


def _core(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words less punctuation at either end."""
    letters = ((data >= 0x30) & (data < 0x3A)) | ((data >= 0x41) & (data < 0x5B)) | ((data >= 0x61) & (data < 0x7B)) | (data >= 0x80)
    count = np.concatenate(([0], np.cumsum(letters)))
    place = np.flatnonzero(letters)
    has = count[words.end] > count[words.start]
    start, end = words.start.copy(), words.end.copy()
    if len(place):
        start[has] = place[count[words.start[has]]]
        end[has] = place[count[words.end[has]] - 1] + 1
    return start, end


def units(data: np.ndarray, words: Words, lengths: tuple[int, ...] = BEGINNINGS) -> list[np.ndarray]:
    """Hashes of each word (without outer punctuation) and of its beginnings; a beginning that is too long is 0."""
    start, end = _core(data, words)
    sums = prefix(BYTE_VALUE[FOLD][data])
    out = []
    for n in lengths:
        upto = start + n if n else end
        fits = upto <= end
        h = np.zeros(len(start), np.uint64)
        h[fits] = (spans(sums, start[fits], upto[fits]) ^ np.uint64(0 if n else WHOLE)) & KEY
        out.append(h)
    return out


class Lexicon:
    """Sorted hashes with weights, behind a bit filter."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def best(self, found: list[np.ndarray]) -> np.ndarray:
        """The largest weight of the units of each word; 0 if none is in the lexicon."""
        out = np.zeros(len(found[0]))
        if not len(self.hashes):
            return out
        for h in found:
            maybe = np.flatnonzero(self.seen[h >> np.uint64(64 - _FILTER_BITS)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            right = self.hashes[at] == h[maybe]
            out[maybe[right]] = np.maximum(out[maybe[right]], self.weights[at[right]])
        return out


def learn_lexicon(doc: np.ndarray, unit: np.ndarray, y: np.ndarray, use: np.ndarray) -> Lexicon:
    """Units of the rows in `use` that are in toxic documents far more often than in others; (doc, unit) are unique pairs."""
    pairs = use[doc]
    share = y[use].mean()
    values, where = np.unique(unit[pairs], return_inverse=True)
    n = np.bincount(where)
    k = np.bincount(where, y[doc[pairs]])
    z = (k - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    likely = (k + 4 * share) / (n + 4)
    good = np.flatnonzero((k >= 3) & (z >= 4) & (likely >= max(0.4, 2 * share)) & (values != 0))
    good = good[np.argsort(-z[good], kind="stable")[:LEXICON_ENTRIES]]
    return Lexicon(values[good], np.log(likely[good] / (1 - likely[good])) - np.log(share / (1 - share)))


def dense(data: np.ndarray, offsets: np.ndarray, words: Words, found: list[np.ndarray], lexicon: Lexicon, seeds: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.maximum(words.count, 1)
    weight = lexicon.best(found)
    seed, you = np.isin(found[0], seeds), np.isin(found[0], second)
    hit = (weight > 0) | seed

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc, values, n)

    near = np.zeros(len(hit), bool)
    at = np.flatnonzero(hit)
    if len(at) and you.any():
        upto = np.concatenate(([0], np.cumsum(you)))
        lo = np.maximum(at - NEAR_WORDS, words.first[words.doc[at]])
        hi = np.minimum(at + NEAR_WORDS + 1, words.first[words.doc[at] + 1])
        near[at] = upto[hi] > upto[lo]
    out[:, 0] = per_doc(hit)
    out[:, 1] = out[:, 0] / size
    out[:, 2] = per_doc(weight)
    out[:, 3] = out[:, 2] / size
    top = np.zeros(n)
    np.maximum.at(top, words.doc[at], weight[at])
    out[:, 4] = top
    out[:, 5] = np.bincount((np.unique(found[0][at] | words.doc[at].astype(np.uint64)) & ~KEY).astype(np.int64), minlength=n)
    out[:, 6] = per_doc(seed)
    out[:, 7] = out[:, 6] / size
    out[:, 8] = per_doc(near)
    out[:, 9] = out[:, 8] / np.maximum(out[:, 0], 1)
    out[:, 10] = per_doc(you) / size
    chars = np.maximum(np.diff(offsets), 1)

    def rate(member: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(member)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / chars

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    other = (data < 128) & ~upper & ~lower & ~((data >= 48) & (data <= 57)) & NONSPACE[data]
    out[:, 11] = rate(upper)
    out[:, 12] = rate(other)
    inside = (~(lower | upper | (data >= 128))) & NONSPACE[data]
    marks = np.concatenate(([0], np.cumsum(inside)))
    start, end = _core(data, words)
    out[:, 13] = per_doc((marks[end] > marks[start]) & (end > start)) / size
    out[:, 14] = rate(data == 33)
    out[:, 15] = np.log1p(words.count)
    return out


def _save(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def fit(texts: pa.Array, y: np.ndarray, ids: np.ndarray) -> bytes:
    if len(set(y.tolist())) < 2:
        return _save(prior=np.array([y.mean()]))
    share = y.mean()
    docs, kept = [], []
    for n in BEGINNINGS:  # one kind after the other, so that few pairs are held at a time
        own, rows = [], []
        for a, _, data, offsets in text_slices(texts):
            words = Words(data, offsets, NONSPACE)
            pairs = np.unique(units(data, words, (n,))[0] | words.doc.astype(np.uint64))
            own.append(pairs & KEY)
            rows.append((pairs & ~KEY).astype(np.int32) + np.int32(a))
        unit, doc = np.concatenate(own), np.concatenate(rows)
        _, where, count = np.unique(unit, return_inverse=True, return_counts=True)
        toxic = np.bincount(where, y[doc])
        # no unit passes that is in fewer toxic documents, or is toxic less often than documents are
        fits = ((toxic >= 3) & (toxic >= share * count))[where]
        docs.append(doc[fits])
        kept.append(unit[fits])
        del own, rows, unit, doc, where, count, toxic, fits
    doc, unit = np.concatenate(docs), np.concatenate(kept)
    seeds, second = hashes_of(SEEDS), hashes_of(SECOND_PERSON)
    fold = np.arange(len(y)) % FOLDS
    lexicons = [learn_lexicon(doc, unit, y, fold != f) for f in range(FOLDS)]
    final = learn_lexicon(doc, unit, y, np.ones(len(y), bool))
    x = np.zeros((len(y), len(FEATURES)))
    for a, b, data, offsets in text_slices(texts):
        words = Words(data, offsets, NONSPACE)
        found = units(data, words)
        for f, lexicon in enumerate(lexicons):
            own = np.flatnonzero(fold[a:b] == f)
            x[a + own] = dense(data, offsets, words, found, lexicon, seeds, second)[own]
    # margins of rows that the trees have not seen make the curve; the trees that are kept see all rows
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        own = fold == f
        margin[own] = boost(x[~own], y[~own]).margin(x[own]) if len(set(y[~own].tolist())) == 2 else 0.0
    knots, heights = isotonic(margin, y.astype(float))
    trees = boost(x, y)
    return _save(
        hashes=final.hashes, weights=final.weights, feature=trees.feature, threshold=trees.threshold, leaf=trees.leaf,
        shape=np.array([trees.depth, trees.rate, trees.start]), knots=knots, heights=heights,
    )


def scorer(model: bytes | None):
    """A function from texts to scores: the isotonic curve, with a little of the margin's own order within its steps."""
    if model is None:
        return lambda texts: np.full(len(texts), 0.5)
    saved = dict(np.load(io.BytesIO(model)))
    if "prior" in saved:
        return lambda texts: np.full(len(texts), float(saved["prior"][0]))
    trees = Trees(int(saved["shape"][0]), float(saved["shape"][1]), float(saved["shape"][2]))
    trees.feature, trees.threshold, trees.leaf = saved["feature"], saved["threshold"], saved["leaf"]
    lexicon = Lexicon(saved["hashes"], saved["weights"])
    seeds, second = hashes_of(SEEDS), hashes_of(SECOND_PERSON)

    def run(texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b, data, offsets in text_slices(texts):
            words = Words(data, offsets, NONSPACE)
            margin = trees.margin(dense(data, offsets, words, units(data, words), lexicon, seeds, second))
            out[a:b] = 0.98 * np.interp(margin, saved["knots"], saved["heights"]) + 0.02 * sigmoid(margin)
        return out

    return run


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label: str = "toxic") -> bytes | None:
    return fit_in_one_task(labelled_sample(docs, labels, label, sample_rows), fit)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score_rows(docs, scorer(train(docs, labels, sample_rows)), THRESHOLD)


def reject_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs whose score is under the threshold."""
    scored = score_rows(docs, scorer(train(docs, labels, sample_rows)), THRESHOLD, carry=True)
    return scored.filter(scored["_score"] < THRESHOLD).select(*docs.columns)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

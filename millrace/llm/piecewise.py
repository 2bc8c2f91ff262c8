"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last SPAN bytes is taken at every byte.  A byte whose hash ends in at least k zero
bits closes a chunk of level k; each chunk gives one of 64 letters from a hash of its contents.
Where the same SPAN bytes come again in a text, each further occurrence has a hash of its own, so
the chunks fall by half from level to level in texts of repeated lines and passages too.  A text's
level is the lowest at which fewer than LETTERS bytes close a chunk (0 for short texts, where every
byte does), so texts whose lengths differ by less than four times have levels at most two apart
(but for chance), and the LETTERS letters at most of a signature spread over the whole text.  A
fingerprint is "level:signature:signature one level up:signature two levels up".  Two fingerprints are compared by edit distance of the signatures of equal level: 1 less distance over
the longer length, and the best of such pairs counts (the topmost signature only where levels are
two apart); if no levels agree, or one text is empty and the other not, the likeness is 0.

Null and empty texts have the fingerprint "0:::", and are alike (1) to each other.  Documents
follow each other by (doc_id, text), nulls first; the last is followed by the first, and a
single document by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import BYTE_VALUE, as_bytes, mix, read_table, slices

SPAN = 7
LETTERS = 64
#: neighbouring levels whose signatures a fingerprint keeps
LEVELS = 3
#: documents of one bucket of the order
BUCKET_ROWS = 4000
#: cuts that the driver holds at most
MOST_BUCKETS = 4096
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def context_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of the last SPAN bytes at each byte; the first bytes of a text see only what there is."""
    value = BYTE_VALUE[data]
    out = value.copy()
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    weight = int(_STEP)
    for back in range(1, SPAN):
        if back < len(data):
            out[back:] += np.where(place[back:] >= back, value[:-back], np.uint64(0)) * np.uint64(weight)
        weight = weight * int(_STEP) % (1 << 64)
    return mix(out)


def closing_levels(hashes: np.ndarray) -> np.ndarray:
    """The number of low zero bits of the hash at each byte of one text, where each further occurrence of a context has a hash of its own.

    Contexts are counted by as many high bits of their hash as leave room for the place."""
    n = len(hashes)
    low = np.uint64((1 << n.bit_length()) - 1)
    order = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
    place = (order & low).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], (order[1:] ^ order[:-1]) > low))) if n else np.zeros(0, np.int64)
    nth = np.zeros(n, np.uint64)
    nth[place] = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    own = np.where(nth > 0, mix(hashes + nth * _STEP), hashes)
    last = own & (~own + np.uint64(1))  # the lowest set bit
    return np.where(last == 0, 63, np.log2(np.maximum(last, np.uint64(1)).astype(np.float64))).astype(np.int64)


def _signature(hashes: np.ndarray, close: np.ndarray) -> bytes:
    """Letters of the chunks that end at `close` (places, ascending) and of what is left after them."""
    if not len(hashes):
        return b""
    start = np.concatenate(([0], close + 1))
    start = start[start < len(hashes)]
    return ALPHABET[(mix(np.add.reduceat(hashes, start)) >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    hashes = context_hashes(data, offsets)
    inner = mix(hashes ^ np.uint64(0xA5A5A5A5))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = closing_levels(hashes[a:b])
        level = int(np.argmax(np.cumsum(np.bincount(own, minlength=64)[::-1])[::-1] < LETTERS))
        signatures = [_signature(inner[a:b], np.flatnonzero(own >= level + up)).decode() for up in range(LEVELS)]
        out.append(":".join([str(level), *signatures]))
    return out


def edit_distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Levenshtein distances of pairs of at most 64 letters, all pairs at once, by bit-parallel columns."""
    n = len(a)
    length_a, length_b = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    if not n:
        return np.zeros(0, np.int64)
    masks = np.zeros((n, 256), np.uint64)
    rows = np.arange(n)
    wide_a, wide_b = (np.frombuffer(b"".join(x.ljust(LETTERS, b"\0") for x in side), np.uint8).reshape(n, LETTERS) for side in (a, b))
    for j in range(int(length_a.max(initial=0))):
        on = rows[length_a > j]
        masks[on, wide_a[on, j]] |= np.uint64(1 << j)
    one, every = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    plus, minus = np.full(n, every), np.zeros(n, np.uint64)
    last = np.where(length_a > 0, one << np.maximum(length_a - 1, 0).astype(np.uint64), np.uint64(0))
    score = length_a.copy()
    for j in range(int(length_b.max(initial=0))):
        live = length_b > j
        match = masks[rows, wide_b[:, j]]
        across = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | ~(across | plus), plus & across
        score += live & ((up & last) != 0)
        score -= live & ((down & last) != 0)
        up, down = (up << one) | one, down << one
        keep = match | minus
        plus = np.where(live, down | ~(keep | up), plus)
        minus = np.where(live, up & keep, minus)
    return np.where(length_a > 0, score, length_b)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness from 0 to 1 of each pair of fingerprints."""
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(left, right, strict=True)])
    pairs: list[tuple[int, bytes, bytes]] = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            continue
        (k, *own), (m, *other) = x.encode().split(b":"), y.encode().split(b":")
        gap = int(k) - int(m)
        # a signature of the topmost level has few letters: it counts where the texts share no other
        for p in range(LEVELS):
            q = p + gap
            if 0 <= q < max(2, abs(gap) + 1) and p < max(2, abs(gap) + 1) and q < LEVELS and own[p] and other[q]:
                pairs.append((i, own[p], other[q]))
    if pairs:
        where, a, b = (list(x) for x in zip(*pairs, strict=True))
        longest = np.maximum(np.fromiter(map(len, a), np.int64), np.fromiter(map(len, b), np.int64))
        np.maximum.at(out, where, 1 - edit_distances(a, b) / longest)
    return np.clip(out, 0.0, 1.0)


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            found = [x for a, b in slices(offsets) for x in fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _texts(texts: list[str]) -> list[str]:
    data, offsets = as_bytes(pa.array(texts, pa.string()))
    return [x for a, b in slices(offsets) for x in fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, follows, doc_id, text) sorted; `follows` is 1 for the copy of the document that comes after the bucket's last."""
    held: tuple | None = None  # the document that still waits for its next one: bucket, id, text, fingerprint
    for batch in batches:
        for a, b in slices(as_bytes(batch.column(3))[1]):
            bucket, follows, ids, texts = (batch.column(i).slice(a, b - a).to_pylist() for i in range(4))
            texts = [x or "" for x in texts]
            prints = _texts(texts)
            rows = ([(held[0], 0, held[1], held[2], held[3])] if held else []) + list(zip(bucket, follows, ids, texts, prints, strict=True))
            pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if x[0] == y[0] and not x[1]]
            held = (rows[-1][0], *rows[-1][2:]) if not rows[-1][1] else None
            if not pairs:
                continue
            changed = [edited(x[3], y[3]) for x, y in pairs]
            marks = _texts(changed)
            own, after = [x[4] for x, _ in pairs], [y[4] for _, y in pairs]
            yield pa.record_batch(
                [
                    pa.array([x[2] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                    pa.array(own),
                    pa.array(marks),
                    pa.array(likeness(own, marks)),
                    pa.array(likeness(own, after)),
                ],
                names=_OUT.names,
            )


def compare_neighbours(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to each other and to the next document's.

    The order of all ids is cut into buckets by quantiles of doc_id.  Each bucket is sorted by
    itself, and gets a copy of the first document of the next one that has any, so texts move
    once and no task sees more than its buckets."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    if not n:
        return docs.sparkSession.createDataFrame([], _OUT)
    # a bucket is sorted outside memory and compared as a stream, so that it may be of any size
    parts = max(1, min(MOST_BUCKETS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // bucket_rows))))
    cuts = sorted(set(rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or [])) if parts > 1 else []
    # the cuts and the first ids are one number for each bucket; rows that repeat a first id come sorted
    # by text, so that the least text follows and the other copies are passed over
    numbered = rows.select("key").mapInArrow(_place(cuts, {}), "bucket int, follows int, key long")
    first = {r[0]: r[1] for r in numbered.groupBy("bucket").agg(F.min("key")).collect()}
    order = sorted(first)
    before = {first[b]: order[i - 1] for i, b in enumerate(order)}
    placed = rows.mapInArrow(_place(cuts, before), "bucket int, follows int, key long, doc_id long, text string")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "follows", "key", "text").select("bucket", "follows", "doc_id", "text").mapInArrow(_compare, _OUT)


def _place(cuts: list[int], before: dict[int, int]):
    """Each row with its bucket, the number of cuts under its key; rows of a bucket's first id also go to the bucket before."""
    edges = np.array(cuts, np.int64)
    firsts = np.array(sorted(before), np.int64)
    to = np.array([before[k] for k in firsts.tolist()], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            again = np.flatnonzero(np.isin(key, firsts))
            take = pa.array(np.concatenate((np.arange(len(key)), again)))
            bucket = np.concatenate((np.searchsorted(edges, key, "left").astype(np.int32), to[np.searchsorted(firsts, key[again])]))
            follows = np.concatenate((np.zeros(len(key), np.int32), np.ones(len(again), np.int32)))
            yield pa.record_batch([pa.array(bucket), pa.array(follows), *[c.take(take) for c in batch.columns]], names=["bucket", "follows", *batch.schema.names])

    return run


def op3_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(read_table(spark, sf_dir, "documents"))

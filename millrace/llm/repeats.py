"""Removal of repeated passages by prefix-free parsing.

A byte goes if a string of LENGTH bytes that covers it also starts in a document of a smaller
doc_id.  Texts are parsed at rolling-hash triggers: of the k-grams of each LENGTH-byte window
the one of the least hash (leftmost of equals) is its trigger, so equal windows have equal
triggers.  Windows that follow each other and share a trigger are a phrase.  Neighbouring phrases
overlap by LENGTH - 1 bytes, so the suffixes of a corpus, cut to LENGTH bytes, are the suffixes
of its phrases, each once, and none of them is a proper prefix of another.

The dictionary is the set of different phrases.  All phrases of a trigger meet, with their bytes,
in one bucket, and the corpus order is made there from two arrays: the dictionary suffixes that
end in the trigger, and the parse suffixes that start with it, both sorted, with the common
lengths of neighbours taken from their bytes.  A window is a suffix of the one followed by a
prefix of the other; windows are equal if and only if they are neighbours in both orders by
enough common bytes.  Of equal windows those of all but the smallest document are repeated.
Hashes only deal the work; no two windows are held equal unless their bytes are.

Before phrases move, a batch keeps one row for each phrase and its smallest document, and answers
the others itself, so a passage that every document has costs a row a batch.  A bucket is folded
whenever it has grown by FOLD_BYTES: what is known as repeated is answered and goes.  If too many
different phrases remain, the bucket is hot: its phrases are parsed again at longer triggers
(TRIGGERS) and dealt over all buckets; the last trigger is the window itself, so that different
windows are apart.  All memory is bounded by the batch, bucket and fold sizes and the longest
text; nothing is collected.

Null and empty texts have no bytes.  Rows with a null doc_id neither lose bytes nor count as
smaller.  Answers go to rows by id and text, so rows that repeat an id are judged each by its own
text, and rows that repeat both are alike.  Very long texts are parsed in overlapping pieces.  An
empty table gives no rows.  Extra columns stay if they are carried; one that has the name of an
output column cannot be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import BYTE_VALUE, as_bytes, mix, prefix, read_table, slices, small_batches, spans, trimmed
from millrace.storage import checkpoint

LENGTH = 50
#: bytes of a trigger at each level
TRIGGERS = (12, 24, 37, 50)
#: bytes of text whose phrases are combined before they move, and whose phrases make one bucket
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
#: bytes of text whose answers and documents meet in one bucket
DOCUMENT_BYTES = 32 << 20
LEAST_BUCKETS = 64
#: bytes of text for each task of a shuffle, where that asks for more tasks than the session does
TASK_BYTES = 64 << 20
#: bytes of phrases after which a bucket is folded; half of them left over make it hot
FOLD_BYTES = 48 << 20
#: a piece of a long text; its positions fit into POSITION_BITS
PIECE = 1 << 22
POSITION_BITS = 24
#: the level of rows that are answers
ANSWER = -1

_U = np.uint64
#: doc_id, hash of the text, place of the trigger in the text, and its least and greatest place in a window
_ENTRY = ((8, "doc"), (8, "text"), (4, "place"), (1, "low"), (1, "high"))
#: windows at, at + 1, ... at + more of a text are repeated
_REPLY = ((8, "doc"), (8, "text"), (4, "at"), (4, "more"))
_ROWS = "level int, bucket int, blob binary"


def _matrix(layout, columns: dict[str, np.ndarray]) -> np.ndarray:
    """One row of bytes for each record, each column in its low bytes."""
    return np.concatenate([np.ascontiguousarray(columns[n].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size] for size, n in layout], axis=1)


def pack(fixed: np.ndarray, data: bytes = b"") -> bytes:
    """Records byte by byte (all first bytes, all second bytes and so on), then free data, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join((len(fixed).to_bytes(4, "little"), fixed.T.tobytes(), data)))


def unpack(layout, blobs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns of all blobs, and their free data one after the other."""
    width = sum(size for size, _ in layout)
    held, free = [np.zeros((0, width), np.uint8)], [np.zeros(0, np.uint8)]
    for packed in blobs:
        blob = zstandard.ZstdDecompressor().decompress(packed)
        n = int.from_bytes(blob[:4], "little")
        held.append(np.frombuffer(blob, np.uint8, n * width, 4).reshape(width, n).T)
        free.append(np.frombuffer(blob, np.uint8, offset=4 + n * width))
    fixed, at, out = np.concatenate(held), 0, {}
    for size, name in layout:
        wide = np.zeros((len(fixed), 8), np.uint8)
        wide[:, :size] = fixed[:, at : at + size]
        out[name] = wide.view("<u8").reshape(-1).view(np.int64)
        at += size
    return out, np.concatenate(free)


def deal(x: np.ndarray, n: int) -> np.ndarray:
    """A bucket under n from the high bits of a hash; it never falls as x grows."""
    return ((x >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def row_key(doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A hash of a row's id and text, which deals and finds rows."""
    return mix(mix(doc.view(_U) + _U(0x1234567)) ^ text.view(_U))


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run."""
    if len(sorted_values):
        cut = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1], [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(sorted_values[a]), a, b


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row, start in the row) of runs of whole texts, or of overlapping pieces of a long one."""
    for a, b in slices(offsets):
        n = int(offsets[b] - offsets[a])
        if b - a > 1 or n <= PIECE:
            yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], np.arange(a, b), np.zeros(b - a, np.int64)
        else:
            for at in range(0, n - LENGTH + 1, PIECE - LENGTH + 1):
                part = data[offsets[a] + at : min(offsets[a] + at + PIECE, offsets[b])]
                yield part, np.array([0, len(part)]), np.array([a]), np.array([at])


class Phrases:
    """Phrases by level, one element each: their records, and their bytes as rows around the trigger, zero where a phrase has none."""

    FIELDS = ("doc", "text", "place", "low", "high", "hash", "bucket_hash", "body")

    def __init__(self, level: int, **fields: np.ndarray):
        self.level = level
        for name in self.FIELDS:
            setattr(self, name, fields[name])

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, chosen: np.ndarray) -> Phrases:
        return Phrases(self.level, **{n: getattr(self, n)[chosen] for n in self.FIELDS})

    @staticmethod
    def join(parts: list[Phrases]) -> Phrases:
        return parts[0] if len(parts) == 1 else Phrases(parts[0].level, **{n: np.concatenate([getattr(p, n) for p in parts]) for n in Phrases.FIELDS})

    def inside(self) -> np.ndarray:
        """Which bytes of the rows belong to the phrase."""
        left = LENGTH - TRIGGERS[self.level]
        column = np.arange(left + LENGTH, dtype=np.int16)
        return (column >= left - self.high[:, None].astype(np.int16)) & (column < left + LENGTH - self.low[:, None].astype(np.int16))


def parse(data: np.ndarray, offsets: np.ndarray, level: int = 0) -> tuple[np.ndarray, Phrases]:
    """The phrases of a run of texts, with places from 0 of each text, and the text number of each; doc and text are to be set."""
    k = TRIGGERS[level]
    left = LENGTH - k
    windows = max(len(data) - LENGTH + 1, 0)
    sums = prefix(BYTE_VALUE[data])
    first = np.arange(max(len(data) - k + 1, 0))
    grams = spans(sums, first, first + k)
    low_bits = _U((1 << POSITION_BITS) - 1)
    least = (grams & ~low_bits) | first.astype(_U)
    width, step = left + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[: len(least) - step], least[step:]) if len(least) > step else least[:0]
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :]) if len(least) > width - step else least[:0]
    trigger = (least[:windows] & low_bits).astype(np.int64)
    size = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    number = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(number)) + np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    own = trigger[at]
    cut = np.flatnonzero(_starts(own, number))
    last = np.append(cut[1:], len(at))[: len(cut)] - 1
    place, begin, end = own[cut], at[cut], at[last]
    padded = np.zeros(len(data) + left + LENGTH, np.uint8)
    padded[left : left + len(data)] = data
    out = Phrases(
        level,
        doc=np.zeros(len(cut), np.int64),
        text=np.zeros(len(cut), np.int64),
        place=place - offsets[number[cut]],
        low=(place - end).astype(np.uint8),
        high=(place - begin).astype(np.uint8),
        hash=spans(sums, begin, end + LENGTH),
        # a trigger's hash is small, being the least of many: mixed again it deals evenly
        bucket_hash=mix(grams[place]),
        body=np.lib.stride_tricks.sliding_window_view(padded, left + LENGTH)[place],
    )
    out.body *= out.inside()
    return number[cut], out


def _starts(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _first(start: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The first value of each row's run."""
    return values[np.maximum.accumulate(np.where(start, np.arange(len(values)), 0))]


def _rows(level: int, bucket: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([level] * len(bucket), pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], names=["level", "bucket", "blob"])


def _replies(doc: np.ndarray, text: np.ndarray, at: np.ndarray, more: np.ndarray, n_docs: int) -> pa.RecordBatch:
    """Answers by bucket of their row; ranges that touch are one."""
    key = row_key(doc, text)
    order = np.lexsort((at, text, doc, key))
    doc, text, at, more, key = (x[order] for x in (doc, text, at, more, key))
    start = _starts(doc, text)
    start[1:] |= at[1:] > at[:-1] + more[:-1] + 1
    where = np.flatnonzero(start)
    end = np.maximum.reduceat(at + more, where) if len(where) else at
    doc, text, at, key = (x[where] for x in (doc, text, at, key))
    fixed = _matrix(_REPLY, {"doc": doc, "text": text, "at": at, "more": end - at})
    found = [(b, pack(fixed[x:y])) for b, x, y in runs(deal(key, n_docs))]
    return _rows(ANSWER, [b for b, _ in found], [x for _, x in found])


def _ranges(p: Phrases, again: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, text, at, more) of the runs of windows that `again` marks: a row for each phrase, a column for each place of the trigger."""
    wide = np.zeros((len(p), again.shape[1] + 2), np.int8)
    wide[:, 1:-1] = again[:, ::-1]
    change = np.diff(wide, axis=1)
    row, begin = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1]
    return p.doc[row], p.text[row], p.place[row] - (again.shape[1] - 1) + begin, end - begin - 1


def combine(parts: list[Phrases], n_buckets: int, n_docs: int) -> Iterator[pa.RecordBatch]:
    """Each phrase of its smallest document by bucket; what other documents have of it is answered.  The list of parts is emptied."""
    p = Phrases.join(parts)
    parts.clear()
    order = np.lexsort((p.place, p.text, p.doc, p.hash))
    doc, text, place, low, high, hashed = (getattr(p, n)[order] for n in ("doc", "text", "place", "low", "high", "hash"))
    same = np.zeros(len(order), bool)
    same[1:] = ~_starts(hashed, low, high)[1:]
    maybe = np.flatnonzero(same)
    for x in range(0, len(maybe), 1 << 15):
        some = maybe[x : x + (1 << 15)]
        same[some] = (p.body[order[some]] == p.body[order[some - 1]]).all(axis=1)
    again = doc != _first(~same, doc)
    twice = np.zeros(len(order), bool)
    twice[1:] = same[1:] & ~_starts(doc, text, place)[1:]
    if again.any():
        q = again & ~twice
        top, least = high[q].astype(np.int64), low[q].astype(np.int64)
        yield _replies(doc[q], text[q], place[q] - top, top - least, n_docs)
    kept = order[~again & ~twice]
    p = p.take(kept[np.argsort(p.bucket_hash[kept], kind="stable")])
    del doc, text, place, low, high, hashed, order, kept, same, again, twice
    inside = p.inside()
    data = p.body[inside]
    at = np.concatenate(([0], np.cumsum(inside.sum(axis=1))))
    del inside
    fixed = _matrix(_ENTRY, {n: getattr(p, n) for _, n in _ENTRY})
    found = [(b, pack(fixed[x:y], data[at[x] : at[y]].tobytes())) for b, x, y in runs(deal(p.bucket_hash, n_buckets))]
    yield _rows(p.level, [b for b, _ in found], [x for _, x in found])


def _parse_texts(n_buckets: int, n_docs: int):
    """Texts (doc_id, text, hash of the text) to phrases by bucket of their trigger, and answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            data, offsets = as_bytes(batch.column(1))
            for part, where, row, start in pieces(data, offsets):
                number, found = parse(part, where)
                found.doc, found.text, found.place = ids[row[number]], hashes[row[number]], found.place + start[number]
                held.append(found)
                size += len(part)
                del found
                if size >= BATCH_BYTES:
                    size = 0
                    yield from combine(held, n_buckets, n_docs)
        if held:
            yield from combine(held, n_buckets, n_docs)

    return run


def read_phrases(level: int, blobs: list[bytes]) -> Phrases:
    columns, data = unpack(_ENTRY, blobs)
    n = len(columns["doc"])
    columns |= {x: columns[x].astype(np.uint8) for x in ("low", "high")}
    p = Phrases(level, **columns, hash=np.zeros(n, _U), bucket_hash=np.zeros(n, _U), body=np.zeros((n, 2 * LENGTH - TRIGGERS[level]), np.uint8))
    p.body[p.inside()] = data
    return p


class Order:
    """The sorted rows of a matrix of bytes, and the number of bytes that each has in common with its predecessor."""

    def __init__(self, rows: np.ndarray):
        n, self.width = rows.shape
        keys = np.ascontiguousarray(rows).view(f"S{self.width}").reshape(-1) if self.width else np.zeros(n)
        order = np.argsort(keys, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.common = np.zeros(n, np.int16)
        for a in range(1, n, 1 << 16):
            b = min(n, a + (1 << 16))
            other = np.ones((b - a, self.width + 1), bool)
            np.not_equal(rows[order[a:b]], rows[order[a - 1 : b - 1]], out=other[:, : self.width])
            self.common[a:b] = other.argmax(axis=1)
        self.common[:1] = -1

    def classes(self, m: int, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
        """A number for each row; equal numbers are equal first m bytes."""
        return np.cumsum(self.common < m)[self.rank[chosen]]


def repeated(p: Phrases) -> np.ndarray:
    """For each phrase and place of the trigger in a window: whether a smaller document has the window.

    `suffixes` orders the dictionary suffixes that end at the trigger (from their ends, as what counts is how far
    two agree), `following` the parse suffixes that begin with it."""
    k = TRIGGERS[p.level]
    left = LENGTH - k
    by_doc = np.argsort(p.doc, kind="stable")
    doc, low, high, body = p.doc[by_doc], p.low[by_doc], p.high[by_doc], p.body[by_doc]
    suffixes, following = Order(body[:, :left][:, ::-1]), Order(body[:, left:])

    def group(before: int, after: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen phrases by class of `before` bytes ahead of the trigger and `after` from it, and where classes start; by document within."""
        key = following.classes(after, chosen) << 32
        if before:
            key |= suffixes.classes(before, chosen)
        order = np.argsort(key, kind="stable")
        return chosen[order], _starts(key[order])

    def shared(before: int, after: int) -> np.ndarray:
        """Phrases of classes that have more than one document."""
        out = np.zeros(len(doc), bool)
        row, start = group(before, after, np.arange(len(doc)))
        where = np.flatnonzero(start)
        own = doc[row]
        many = own[where] != own[np.append(where[1:], len(own))[: len(where)] - 1]
        out[row] = np.repeat(many, np.diff(np.append(where, len(own))))
        return out

    out = np.zeros((len(doc), left + 1), bool)
    half = (left + 1) // 2
    # a window has at least `half` bytes ahead of its trigger, or more than LENGTH - half from it
    far, near = shared(half, k), shared(0, LENGTH - half + 1)
    for o in range(left + 1):
        row, start = group(o, LENGTH - o, np.flatnonzero((far if o >= half else near) & (low <= o) & (o <= high)))
        out[by_doc[row], o] = doc[row] != _first(start, doc[row])
    return out


def split(p: Phrases) -> Phrases:
    """The phrases of the next level that the windows of these make."""
    inside = p.inside()
    data, offsets = p.body[inside], np.concatenate(([0], np.cumsum(inside.sum(axis=1))))
    parts = []
    for a, b in slices(offsets):
        number, q = parse(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], p.level + 1)
        number += a
        q.doc, q.text, q.place = p.doc[number], p.text[number], q.place + p.place[number] - p.high[number]
        parts.append(q)
    return Phrases.join(parts)


def _meet(level: int, n_buckets: int, n_docs: int):
    """Phrases, rows (level, bucket, blob) sorted by bucket, to answers, and of hot buckets to phrases of the next level."""
    last = level == len(TRIGGERS) - 1

    def deeper(p: Phrases) -> Iterator[pa.RecordBatch]:
        if len(p):
            yield from combine([split(p)], n_buckets, n_docs)

    def bucket_of(blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        known: list[Phrases] = []
        new, size, hot = [], 0, False

        def fold() -> Iterator[pa.RecordBatch]:
            p = Phrases.join([*known, read_phrases(level, new)])
            if size >= FOLD_BYTES:
                order = np.lexsort((p.low, p.place, p.text, p.doc))
                # rows of one id and text give each phrase as often as batches have them
                p = p.take(order[_starts(p.doc[order], p.text[order], p.place[order], p.low[order])])
            again = repeated(p)
            if again.any():
                yield _replies(*_ranges(p, again), n_docs)
            # a phrase whose windows are all repeated has said what it can
            known[:] = [p.take(again.sum(axis=1) < p.high.astype(np.int64) - p.low + 1)]

        for blob in blobs:
            new.append(blob)
            size += zstandard.frame_content_size(blob) * 3 // 2
            if size < FOLD_BYTES:
                continue
            if hot:
                yield from deeper(read_phrases(level, new))
            else:
                yield from fold()
                hot = not last and known[0].body.size > FOLD_BYTES // 2
                if hot:
                    yield from deeper(known.pop())
            new, size = [], 0
        if hot:
            yield from deeper(read_phrases(level, new))
        elif new:
            yield from fold()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: list[tuple[int, bytes]] = []

        def rows() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for own, bucket, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if own == ANSWER:
                        answers.append((bucket, blob))
                    else:
                        yield bucket, blob

        for _, group in groupby(rows(), key=itemgetter(0)):
            yield from bucket_of(blob for _, blob in group)
            if answers:
                yield _rows(ANSWER, [b for b, _ in answers], [x for _, x in answers])
                answers.clear()
        if answers:
            yield _rows(ANSWER, [b for b, _ in answers], [x for _, x in answers])

    return run


def _pack_documents(n: int):
    """Documents (doc_id, text, hash of the text, carried columns) as compressed Arrow blocks by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, hashes = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 2))
            # rows without an id have no answers and may go anywhere
            bucket = np.where(np.asarray(batch.column(0).is_null()), np.arange(batch.num_rows) % n, deal(row_key(ids, hashes), n))
            order = np.argsort(bucket, kind="stable")
            sorted_batch = batch.take(pa.array(order))
            buckets, blobs = [], []
            for b, x, y in runs(bucket[order]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(sorted_batch.slice(x, y - x))
                buckets.append(b)
                blobs.append(sink.getvalue().to_pybytes())
            yield _rows(0, buckets, blobs)

    return run


class Answers:
    """The answers of a bucket of documents."""

    def __init__(self, blobs: list[bytes]):
        found, _ = unpack(_REPLY, blobs)
        key = row_key(found["doc"], found["text"])
        order = np.argsort(key)
        self.key = key[order]
        self.columns = {n: x[order] for n, x in found.items()}

    def of(self, doc: int, text: int, key: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        c = {n: x[a:b] for n, x in self.columns.items()}
        own = (c["doc"] == doc) & (c["text"] == text)
        return c["at"][own], c["more"][own]


def removed_runs(n_bytes: int, at: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that windows [at, at + more] cover."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.minimum(at + more + LENGTH, n_bytes)
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], at[1:] > end[:-1]))
    return at[new], end[np.concatenate((new[1:], [True]))]


def _lay_over(carried: int, digest: bool):
    """Each document with its removed runs: counts and the hash of what is left, or the text that is left.

    Rows (level, bucket, blob) come sorted by bucket, and in it answers before documents."""

    def laid(own: pa.RecordBatch, found: Answers) -> pa.RecordBatch:
        ids, hashes = (own.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 2))
        key, known = row_key(ids, hashes), ~np.asarray(own.column(0).is_null())
        data, offsets = as_bytes(own.column(1))
        rows: list[tuple] = []
        for i in range(own.num_rows):
            raw = data[offsets[i] : offsets[i + 1]]
            start, end = removed_runs(len(raw), *found.of(ids[i], hashes[i], key[i])) if known[i] else ((), ())
            kept = raw.tobytes()
            if len(start):
                kept = b"".join(kept[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(kept)], strict=True))
            rows.append((len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "ignore")))
        n, removed, count, last = zip(*rows, strict=True)
        out = [own.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(last, pa.string())]
        return pa.record_batch([*out, *[own.column(3 + i) for i in range(carried)]], names=[f"c{i}" for i in range(5 + carried)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, found = None, [], None
        for batch in batches:
            for level, bucket, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now:
                    now, blobs, found = bucket, [], None
                if level == ANSWER:
                    blobs.append(blob)
                    continue
                if found is None:
                    found, blobs = Answers(blobs), []
                for block in pa.ipc.open_stream(blob):
                    yield laid(block, found)

    return run


def remove_repeats(docs: DataFrame, digest: bool = False, carry: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept text or with digest its sha256, carried columns) of every row.

    All other columns are carried unless they are named or have the name of an output column.
    Where a cut splits a character of the kept text, its left-over bytes are dropped from the text (not from the digest)."""
    spark = docs.sparkSession
    small_batches(spark)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "text"]
    if carry is None:
        carry = tuple(c for c in docs.columns if c not in {*names, "text"})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(carry)])
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    ids = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("n"), (F.min("text_hash") < F.max("text_hash")).alias("differ"))
    total, differ = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bool_or(F.col("differ") & F.col("doc_id").isNotNull()), F.lit(False))).first()
    if not differ:
        # an id tells a row's text already, so the hash need not move with each phrase
        rows = rows.withColumn("text_hash", F.lit(0).cast("long"))
    n, n_docs = (max(LEAST_BUCKETS, -(-total // size)) for size in (BUCKET_BYTES, DOCUMENT_BYTES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "bucket").sortWithinPartitions("bucket", "level")

    found = rows.filter("doc_id is not null").select("doc_id", "text", "text_hash").mapInArrow(trimmed(_parse_texts(n, n_docs)), _ROWS)
    answers = []
    for level in range(len(TRIGGERS)):
        found = checkpoint(by_bucket(found).mapInArrow(trimmed(_meet(level, n, n_docs)), _ROWS))
        answers.append(found.filter(F.col("level") == ANSWER))
        found = found.filter(F.col("level") != ANSWER)
        if found.isEmpty():
            break

    packed = rows.select("doc_id", "text", "text_hash", *[f"x{i}" for i in range(len(carry))]).mapInArrow(trimmed(_pack_documents(n_docs)), _ROWS)
    kinds = [T.LongType()] * 4 + [T.StringType()] + [docs.schema[c].dataType for c in carry]
    schema = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)])
    both = by_bucket(reduce(DataFrame.unionByName, answers, packed))
    return both.mapInArrow(trimmed(_lay_over(len(carry), digest)), schema).toDF(*names, *carry)


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), digest=True, carry=())

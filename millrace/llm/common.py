"""What the text operators share: table access, checkpoints, folds, and
vectorised access to the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.workers import reach

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes of text that one vectorised step works on (a single longer text is one step)
SLICE_BYTES = 1 << 18
#: bytes of an Arrow batch
ARROW_BYTES = 8 << 20
SLICE_ROWS = (1 << 16) - 1


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that Python workers hold little at a time (a longer text is a batch of its own);
    and workers that can import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    reach(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run):
    """A batch function that gives memory back when its task ends."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    while name in columns:
        name = "_" + name
    return name


def held_out(doc_id: Column) -> Column:
    """Rows of the fold that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row, and of SLICE_ROWS rows."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1), at + SLICE_ROWS)
        yield at, to
        at = to


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each step over a string column."""
    data, offsets = as_bytes(column)
    for a, b in slices(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


# ---- rolling polynomial hashes, modulo 2**64 -------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}
#: a random 64-bit value for each byte
BYTE_VALUE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) for i under n."""
    if len(_powers[inverse]) < n:
        one = np.full(max(n, 1 << 16), BASE_INVERSE if inverse else BASE, np.uint64)
        one[0] = 1
        _powers[inverse] = np.cumprod(one, dtype=np.uint64)
    return _powers[inverse][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, one longer than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of values[start:end] for each pair."""
    return mix((sums[end] - sums[start]) * powers(len(sums), True)[start] + (end - start).astype(np.uint64))


def word_class(pattern_bytes: bytes) -> np.ndarray:
    """A table of the bytes that belong to words."""
    out = np.zeros(256, bool)
    out[np.frombuffer(pattern_bytes, np.uint8)] = True
    return out


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after folding A-Z: digits, letters and all of non-ASCII
ALNUM = word_class(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)) + bytes(range(0x41, 0x5B)))
#: [^\x20\x09-\x0D]
NONSPACE = ~word_class(b" \t\n\x0b\x0c\r")


class Words:
    """The words of a run of texts: byte ranges, hashes of the folded bytes, and where each text begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: bool = True):
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = member[data]
        left = inside[:-1].copy()
        left[offsets] = False
        right = inside[1:].copy()
        right[offsets] = False
        #: a word starts where the byte is inside and its left neighbour is not, or a text begins
        self.start = np.flatnonzero(inside[1:-1] & ~left[:-1])
        self.end = np.flatnonzero(inside[1:-1] & ~right[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        value = (BYTE_VALUE[FOLD] if fold else BYTE_VALUE)[data]
        self.hash = spans(prefix(value), self.start, self.end)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of k words that stays in one text."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, spans(prefix(self.hash), at, at + k)

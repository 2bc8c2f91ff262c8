"""Benchmark decontamination by a broadcast hash set of n-gram windows.

Words are runs of [0-9a-z] and non-ASCII after A-Z is folded.  A window is `n` consecutive
words of a benchmark item; an item of fewer words (but not none) is one window.  Every window
of every text is hashed in one vectorised pass, looked up, and each hit is verified by its
words.  Different windows are made by Spark and reach the executors in blocks of about
BLOCK_WINDOWS, by a hash of window and item, so that neither a long item nor a frequent window
makes a block larger.  A benchmark of more windows takes one pass over the documents for each
block; a pass is checkpointed before the next block is read, so one block lives at a time, and
hits of all passes add up.

Null texts have no words.  An item without an id marks words but is not counted as an item;
rows that repeat an id count once.  Repeated documents get equal results; a very long text is
scanned by itself.  Without windows or without rows the columns are the same.  Extra columns are
carried as they are; if one has the name of the result, the result gets an underscore before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import ALNUM, Words, as_bytes, lower_ascii, read_table, text_slices, trimmed, unused
from millrace.storage import checkpoint

WINDOW = 13
#: about 100 MB in a Python worker
BLOCK_WINDOWS = 250_000
#: a document is contaminated if hits are at least one in so many words
RATIO = 20
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FILTER_BITS = 20

RUN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("words", T.ArrayType(RUN)),
        T.StructField("bytes", T.ArrayType(RUN)),
    ]
)
_RUN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


class WindowTable:
    """A block of windows (item, words), by length: a bit filter, hashes, and words to items."""

    def __init__(self, windows: list[tuple[str | None, str]]):
        self.items: dict[bytes, set[str]] = {}
        for item, gram in windows:
            self.items.setdefault(gram.encode(), set()).update([item] if item is not None else [])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in {x.count(b" ") + 1 for x in self.items}:
            texts = pa.array([x.decode() for x in self.items if x.count(b" ") + 1 == length])
            hashes = np.unique(Words(*as_bytes(texts), ALNUM).grams(length)[1])
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_length[length] = seen, hashes

    def hits(self, words: Words, data: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, end word, items) of each verified window."""
        for length, (seen, hashes) in self.by_length.items():
            at, found = words.grams(length)
            maybe = np.flatnonzero(seen[found >> np.uint64(64 - _FILTER_BITS)])
            maybe = maybe[hashes[np.minimum(np.searchsorted(hashes, found[maybe]), len(hashes) - 1)] == found[maybe]]
            for w in at[maybe].tolist():
                span = data[words.start[w] : words.end[w + length - 1]].tobytes().lower()
                items = self.items.get(b" ".join(_WORD.findall(span)))
                if items is not None:
                    yield w, w + length, items


def _scan(table: WindowTable, carried: int, before: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns: the carried ones, the text, and the result of an earlier pass if there was one."""
        for batch in batches:
            earlier = batch.column(carried + 1).to_pylist() if before else None
            rows: list[dict] = []
            for a, b, data, offsets in text_slices(batch.column(carried)):
                words = Words(data, offsets, ALNUM)
                edge = np.zeros(len(words.start) + 1, np.int64)
                items: dict[int, set[str]] = {}
                for w, end, found in table.hits(words, data):
                    edge[w] += 1
                    edge[end] -= 1
                    items.setdefault(int(words.doc[w]), set()).update(found)
                for i, was in enumerate(earlier[a:b] if before else ()):
                    for x in was["words"]:
                        edge[words.first[i] + x["start"]] += 1
                        edge[words.first[i] + x["end"]] -= 1
                    items.setdefault(i, set()).update(was["items"])
                hit = np.cumsum(edge[:-1]) > 0
                # maximal runs of hit words that stay in one text
                left = np.concatenate(([False], hit[:-1])) if len(hit) else hit
                right = np.concatenate((hit[1:], [False])) if len(hit) else hit
                firsts = words.first[:-1][words.count > 0]
                left[firsts] = False
                right[firsts[1:] - 1] = False
                begin, end = np.flatnonzero(hit & ~left), np.flatnonzero(hit & ~right) + 1
                runs: dict[int, list[tuple[int, int]]] = {}
                for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                    runs.setdefault(int(words.doc[s]), []).append((s, e))
                count = np.bincount(words.doc[hit], minlength=b - a)
                for i in range(b - a):
                    own, base, at = runs.get(i, ()), int(words.first[i]), int(offsets[i])
                    rows.append(
                        {
                            "n_words": int(words.count[i]),
                            "n_hit": int(count[i]),
                            "items": sorted(items.get(i, ())),
                            "words": [{"start": s - base, "end": e - base} for s, e in own],
                            "bytes": [{"start": int(words.start[s]) - at, "end": int(words.end[e - 1]) - at} for s, e in own],
                        }
                    )
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("words", pa.list_(_RUN)), ("bytes", pa.list_(_RUN))])
            keep = [batch.column(i) for i in range(carried)]
            yield pa.record_batch([*keep, batch.column(carried), pa.array(rows, kind)], names=[f"c{i}" for i in range(carried + 2)])

    return run


def windows_of(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The different (item, gram) of a benchmark: words of each window, joined by spaces."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))
    places = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    grams = F.transform(places, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).filter(F.size("w") > 0)
    return items.select("item", F.explode(grams).alias("gram")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", result: str = "contamination", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with a struct column: word counts, the items found, and the runs of hit words (word and byte offsets)."""
    pairs = checkpoint(windows_of(benchmark, n))
    blocks = -(-pairs.count() // block_windows) or 1
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    current = docs.toDF(*names).withColumn("t", F.col(names[docs.columns.index(text)]).cast("string"))
    for block in range(blocks):
        table = WindowTable([tuple(r) for r in pairs.filter(F.pmod(F.xxhash64("gram", "item"), F.lit(blocks)) == block).collect()])
        out = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField(f"c{len(fields)}", T.StringType()), T.StructField(f"c{len(fields) + 1}", RESULT)])
        current = current.mapInArrow(trimmed(_scan(table, len(fields), block > 0)), out)
        if blocks > 1:
            current = checkpoint(current)
    return current.drop(f"c{len(fields)}").toDF(*docs.columns, unused(result, docs.columns))


def contaminated(result: str = "contamination"):
    hit, words = F.col(f"{result}.n_hit"), F.col(f"{result}.n_words")
    return (hit > 0) & (hit * RATIO >= words)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if runs:
                raw, at, kept = text.encode(), 0, []
                for x in runs:
                    kept.append(raw[at : x["start"]])
                    at = x["end"]
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        yield pa.record_batch([*batch.columns[:-2], pa.array(out, pa.string())], names=[f"c{i}" for i in range(batch.num_columns - 1)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW) -> DataFrame:
    """Without contaminated documents, or (mode "spans") with every hit run cut out of the texts."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    tag = unused("_contamination", docs.columns)
    found = contamination(docs, benchmark, n, result=tag)
    if mode == "documents":
        return found.filter(~contaminated(tag)).select(*docs.columns)
    at = docs.columns.index("text")
    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(rest)] + [T.StructField(f"c{len(rest)}", T.StringType())])
    cut = found.select(*rest, "text", F.col(f"{tag}.bytes")).mapInArrow(_cut, schema).toDF(*rest, "text")
    return cut.select(*rest[:at], "text", *rest[at:])


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark")).drop("text")
    c = "contamination"
    return found.select(
        "doc_id",
        f"{c}.n_words",
        f"{c}.n_hit",
        F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f"{c}.items"), 256).alias("items_sha256"),
        contaminated(c).alias("contaminated"),
    )

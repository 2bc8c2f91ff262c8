"""Bounded labelled samples, and the training of a model in one task over such a sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, trimmed


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int = 7) -> DataFrame:
    """(doc_id, t, y) of at most `rows` labelled documents outside the held-out fold, chosen by a hash of the id.

    Ids and labels that are null do not count; repeated labels of an id give their rounded mean,
    and of repeated documents of an id one (the least text) is taken."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    # the chosen ids are `rows` at most, so their side of the join has a proven size
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"), F.first("y").alias("y"))


def fit_in_one_task(sample: DataFrame, fit: Callable[[pa.Array, np.ndarray, np.ndarray], bytes]) -> bytes | None:
    """What fit(texts, labels, ids) returns for a bounded sample; None if the sample is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).sort_by("doc_id")
            held.clear()
            model = fit(table.column("t").combine_chunks(), table.column("y").to_numpy().astype(np.int64), table.column("doc_id").to_numpy())
            yield pa.record_batch([pa.array([model], pa.binary())], names=["model"])

    found = sample.select("doc_id", "t", "y").repartition(1).mapInArrow(trimmed(run), "model binary").collect()
    return bytes(found[0][0]) if found else None


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def score_rows(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], threshold: float, carry: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; with carry, all columns of docs and a column _score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(batch.column(batch.num_columns - 1))
            yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.float64())], names=[f"c{i}" for i in range(batch.num_columns)])

    text = F.col("text").cast("string").alias("t")
    if carry:
        names = docs.columns
        inner = docs.select(*names, text).toDF(*[f"c{i}" for i in range(len(names))], "t")
        kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
        return inner.mapInArrow(trimmed(run), f"{kinds}, c{len(names)} double").toDF(*names, "_score")
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(trimmed(run), "c0 long, c1 double").toDF("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

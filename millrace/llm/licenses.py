"""License scans by diagonal voting.

Templates (base phrases and notices) are cut into word k-grams.  Every rolling k-gram of every
text is hashed, and a Spark join on the hash (and on the words themselves, so that no chance
collision stays) gives pairs of a document position and a template position.  Pairs are counted
by diagonal, document position minus template position; diagonals of one template that lie
within GAP words are merged, as an inserted or missing word shifts what follows; a merged
match counts if enough of the template's words are covered within a span of about its length.
The notices are paragraphs of public licences, so that a copy with words added, missing or changed
still gathers most of its votes; a copy cut to less than COVERED of the paragraph is not one.

The templates are constants of this module (a few hundred grams), so their side of the join is
broadcast and a bit filter of their hashes is applied where grams are made.

A null text has no words; an empty table gives no rows.  Repeated rows and ids stay apart by the
row's own number.  A very long text is cut into grams by itself, and only its hits move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ALNUM, Words, as_bytes, read_table, text_slices

#: grams of phrases and of notices
PHRASE_WORDS, NOTICE_WORDS = 2, 5
GAP = 4
COVERED = 0.6
_FILTER_BITS = 16

# The base phrases with their labels, and wording of public licences, lower case and without punctuation.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "mit-grant": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions""",
    "mit-condition": """
        the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software""",
    "mit-warranty": """
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties
        of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders
        be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of
        or in connection with the software or the use or other dealings in the software""",
    "apache-2.0-header": """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or
        agreed to in writing software distributed under the license is distributed on an as is basis without warranties or
        conditions of any kind either express or implied see the license for the specific language governing permissions and
        limitations under the license""",
    "gpl-header": """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation either version 3 of the license or at your option any later version this
        program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public license for more details you should have
        received a copy of the gnu general public license along with this program""",
    "lgpl-header": """
        this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public
        license as published by the free software foundation either version 2 1 of the license or at your option any later
        version this library is distributed in the hope that it will be useful but without any warranty""",
    "bsd-conditions": """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and
        the following disclaimer in the documentation and or other materials provided with the distribution""",
    "isc-grant": """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
    "mpl-2.0-header": """
        this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
        with this file you can obtain one at https mozilla org mpl 2 0""",
    "unlicense": """
        this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
        sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
        commercial and by any means""",
}


def templates() -> list[tuple[int, str, str, int, list[str]]]:
    """(template, label, kind, k, words) of each."""
    base = [(label, "phrase", PHRASE_WORDS, text) for text, label in PHRASES.items()]
    more = [(label, "notice", NOTICE_WORDS, text) for label, text in NOTICES.items()]
    return [(i, label, kind, k, text.split()) for i, (label, kind, k, text) in enumerate(base + more)]


def gram_rows() -> list[tuple[int, int, int, str, int]]:
    """(k, hash, template, gram, position) of every k-gram of every template."""
    out = []
    for number, _, _, k, words in templates():
        texts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        found = Words(*as_bytes(pa.array(texts)), ALNUM).grams(k)[1].view(np.int64).tolist()
        out += [(k, h, number, text, i) for i, (h, text) in enumerate(zip(found, texts, strict=True))]
    return out


def _grams(hashes: dict[int, np.ndarray]):
    """One row (pos -1) for each text, and one for each of its grams that the filter lets by."""
    seen = {}
    for k, own in hashes.items():
        seen[k] = np.zeros(1 << _FILTER_BITS, bool)
        seen[k][own.view(np.uint64) >> np.uint64(64 - _FILTER_BITS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets, ALNUM)
                cols: list[list[np.ndarray]] = [[np.arange(b - a)], [np.full(b - a, -1)], [np.zeros(b - a, np.int64)], [np.zeros(b - a, np.int64)]]
                texts: list[str | None] = [None] * (b - a)
                for k in seen:
                    at, found = words.grams(k)
                    keep = np.flatnonzero(seen[k][found >> np.uint64(64 - _FILTER_BITS)])
                    at, found = at[keep], found[keep]
                    for col, x in zip(cols, (words.doc[at], at - words.first[words.doc[at]], np.full(len(at), k), found.view(np.int64)), strict=True):
                        col.append(x)
                    for w in at.tolist():
                        spans = zip(words.start[w : w + k].tolist(), words.end[w : w + k].tolist(), strict=True)
                        texts.append(b" ".join(data[s:e].tobytes().lower() for s, e in spans).decode("utf-8", "replace"))
                doc, pos, width, found = (np.concatenate(c) for c in cols)
                take = pa.array(doc + a)
                yield pa.record_batch(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(words.count[doc].astype(np.int64)), pa.array(width.astype(np.int32)), pa.array(pos.astype(np.int64)), pa.array(found), pa.array(texts, pa.string())],
                    names=["row", "doc_id", "n_words", "k", "pos", "hash", "gram"],
                )

    return run


def _matches(found: list[dict], known: list[tuple[int, str, str, int, list[str]]]) -> tuple[list[int], set[str], set[str], float, list[tuple[str, int, int, float]]]:
    """Starts of base phrases, their labels, the notices' labels, a score, and (label, first word, end word, coverage) of each span."""
    places: list[int] = []
    base: set[str] = set()
    more: set[str] = set()
    spans: list[tuple[str, int, int, float]] = []
    merged: list[list] = []
    for m in sorted(found, key=lambda m: (m["template"], m["diagonal"])):
        _, label, kind, k, words = known[m["template"]]
        if kind == "phrase":
            if len(set(m["at"])) == len(words) - k + 1:
                places.append(m["diagonal"])
                base.add(label)
                spans.append((label, m["diagonal"], m["diagonal"] + len(words), 1.0))
        elif merged and merged[-1][0] == m["template"] and m["diagonal"] - merged[-1][1] <= GAP:
            merged[-1][1] = m["diagonal"]
            merged[-1][2] += [(m["diagonal"], x) for x in m["at"]]
        else:
            merged.append([m["template"], m["diagonal"], [(m["diagonal"], x) for x in m["at"]]])
    for template, _, votes in merged:
        _, label, _, k, words = known[template]
        covered = {x + i for _, x in votes for i in range(k)}
        first, end = min(d + x for d, x in votes), max(d + x for d, x in votes) + k
        share = len(covered) / len(words)
        if share >= COVERED and end - first <= 2 * len(words):
            more.add(label)
            spans.append((label, first, end, share))
    return places, base, more, max((s[3] for s in spans), default=0.0), sorted(spans, key=lambda s: (s[1], s[2], s[0]))


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])


def _decide(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_matches([m for m in found if m["template"] is not None], known) for found in batch.column(3).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(1),
                    batch.column(2),
                    pa.array([len(p) for p, *_ in out], pa.int64()),
                    pa.array([min(p, default=None) for p, *_ in out], pa.int64()),
                    pa.array([max(p, default=None) for p, *_ in out], pa.int64()),
                    pa.array([",".join(sorted(b)) for _, b, *_ in out], pa.string()),
                    pa.array([",".join(sorted(b | m)) for _, b, m, *_ in out], pa.string()),
                    pa.array([x for *_, x, _ in out], pa.float64()),
                    pa.array([[dict(zip(("label", "first", "end", "coverage"), s, strict=True)) for s in x] for *_, x in out], pa.list_(_SPAN)),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return run


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts, labels, a score and the matched spans (in words) of every row."""
    spark = docs.sparkSession
    rows = gram_rows()
    table = spark.createDataFrame(rows, "k int, hash long, template int, gram string, at int")
    hashes = {k: np.array([r[1] for r in rows if r[0] == k], np.int64) for k in (PHRASE_WORDS, NOTICE_WORDS)}
    grams = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(
        _grams(hashes), "row long, doc_id long, n_words long, k int, pos long, hash long, gram string"
    )
    hits = grams.join(F.broadcast(table), ["k", "hash", "gram"], "left").filter("pos < 0 or template is not null")
    votes = hits.groupBy("row", "doc_id", "n_words", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_list("at").alias("at"))
    found = votes.groupBy("row", "doc_id", "n_words").agg(F.collect_list(F.struct("template", "diagonal", "at")).alias("found"))
    return found.select("row", "doc_id", "n_words", "found").mapInArrow(
        _decide(templates()),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label string, first bigint, end bigint, coverage double>>",
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).drop("spans")

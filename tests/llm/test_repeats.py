import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import repeats


def brute(docs):
    """docs: (id, bytes) in any order."""
    found = []
    first = {}
    for i, b in docs:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    for i, b in docs:
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        found.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(found)


def in_process(docs, n=5, batch=7):
    """The same steps without Spark, so that limits can be made small."""
    hashes = [int.from_bytes(hashlib.sha256(b).digest()[:8], "little", signed=True) for _, b in docs]
    batches = []
    for a in range(0, len(docs), batch):
        ids, texts = zip(*docs[a : a + batch], strict=True)
        batches.append(pa.record_batch([pa.array(ids, pa.int64()), pa.array([b.decode() for b in texts], pa.string()), pa.array(hashes[a : a + batch], pa.int64())], names=["doc_id", "text", "text_hash"]))

    def rows(out):
        return [r for b in out for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]

    def back(triples):
        triples = sorted(triples, key=lambda r: (r[1], r[0]))
        kinds = zip(zip(*triples, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)
        return iter([pa.record_batch([pa.array(c, k) for c, k in kinds], names=["level", "bucket", "blob"])]) if triples else iter([])

    # each batch by itself, as tasks would see them
    found = [r for b in batches for r in rows(repeats._parse_texts(n, n)(iter([b])))]
    answers, levels = [], 0
    for level in range(len(repeats.TRIGGERS)):
        found = rows(repeats._meet(level, n, n)(back(found)))
        answers += [r for r in found if r[0] == repeats.ANSWER]
        found = [r for r in found if r[0] != repeats.ANSWER]
        levels += 1
        if not found:
            break
    assert not found
    out = []
    for b in repeats._lay_over(0, True)(back(answers + rows(repeats._pack_documents(n)(iter(batches))))):
        out += zip(*(c.to_pylist() for c in b.columns), strict=True)
    in_process.levels = levels
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["la", "ti", "on", "the", "é", "ing", "ß", "x"]

    def text(k):
        return "".join(rng.choice(words) + rng.choice(" \n" if rng.random() < 0.1 else " a") for _ in range(k))

    shared = [text(rng.randrange(10, 60)) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randrange(1, 40)) for _ in range(rng.randrange(0, 6))]
        out.append((i * 3 - 20, "".join(parts).encode()))
    out.append((500, b"a" * 300))
    out.append((501, b"a" * 49))
    out.append((502, b"ab" * 200))
    out.append((503, b"a" * 120 + b"ab" * 40))
    out.append((504, b""))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_in_process_matches_brute_force(seed):
    docs = corpus(seed)
    assert in_process(docs) == brute(docs)


@pytest.mark.parametrize("seed", range(4))
def test_hot_triggers_and_pieces(monkeypatch, seed):
    """Buckets that are folded after every row of phrases, and parsed again down to whole windows."""
    monkeypatch.setattr(repeats, "FOLD_BYTES", 1)
    monkeypatch.setattr(repeats, "PIECE", 120)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 500)
    docs = corpus(seed)
    assert in_process(docs, batch=3) == brute(docs)
    assert in_process.levels == len(repeats.TRIGGERS)


@pytest.mark.parametrize("fold", [2_000, 20_000])
def test_a_bucket_turns_hot_after_some_rows(monkeypatch, fold):
    monkeypatch.setattr(repeats, "FOLD_BYTES", fold)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 500)
    line = b"this line of more than fifty bytes stands in many of the documents here. "
    docs = [(i, f"{i * 7919} begins ".encode() * 3 + line + f" ends {i * 104729}".encode() * 3) for i in range(80)] + [(100, b"quite other words before " + line + b"and after it, once only")]
    assert in_process(docs, batch=14) == brute(docs)
    moved = [(50 if i == 100 else i + 60, b) for i, b in docs]
    assert in_process(moved, batch=14) == brute(moved)


def test_hashes_that_agree_do_not_make_windows_equal(monkeypatch):
    """With all bytes hashed alike every window has a trigger of the same hash; only bytes tell them apart."""
    monkeypatch.setattr(repeats, "BYTE_VALUE", np.ones(256, np.uint64))
    docs = corpus(1)
    assert in_process(docs) == brute(docs)


def test_repeated_ids_are_judged_by_row():
    """A row of an id loses nothing for what another row of that id has, nor for its own copies."""
    rng = random.Random(3)
    one, two, tail = letters(rng, 200), letters(rng, 220), letters(rng, 60)
    docs = [(1, one), (2, one + tail), (2, two), (2, two), (5, two), (5, two), (1, one)]
    for batch in (1, 3, 7):
        assert in_process(docs, batch=batch) == brute(docs)
    assert [r[2] for r in brute(docs) if r[0] == 2] == [0, 0, 200]


def test_common_bytes_of_neighbours():
    rng = random.Random(5)
    rows = np.array([[rng.randrange(2) for _ in range(9)] for _ in range(200)], np.uint8)
    order = repeats.Order(rows)
    for m in range(1, 10):
        classes = order.classes(m)
        seen = {}
        for row, c in zip(rows, classes.tolist(), strict=True):
            assert seen.setdefault(c, bytes(row[:m])) == bytes(row[:m])
        assert len(seen) == len({bytes(r[:m]) for r in rows})


def letters(rng, n):
    return bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def test_packing_keeps_values():
    rng = np.random.default_rng(1)
    columns = {"doc": rng.integers(-1 << 62, 1 << 62, 99), "text": rng.integers(-1 << 62, 1 << 62, 99), "at": rng.integers(0, 1 << 32, 99), "more": rng.integers(0, 1 << 32, 99)}
    back, free = repeats.unpack(repeats._REPLY, [repeats.pack(repeats._matrix(repeats._REPLY, columns), b"xyz")] * 2)
    assert all((back[n] == np.tile(c, 2)).all() for n, c in columns.items()) and free.tobytes() == b"xyzxyz"
    back, free = repeats.unpack(repeats._REPLY, [])
    assert len(free) == 0 and all(len(c) == 0 for c in back.values())


def test_query_on_small_table(spark, sf):
    docs = [(r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, repeats.op8_suffix_array_dedup(spark, sf).collect())) == brute(docs)


def test_awkward_rows(spark, awkward, none):
    long = awkward.selectExpr("doc_id", "repeat(coalesce(text, ''), 3) as text", "bucket", "lang")
    got = repeats.remove_repeats(long, carry=("bucket", "lang"))
    rows = got.collect()
    assert len(rows) == awkward.count() and got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "text", "bucket", "lang"]
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_removed"] == by[2]["n_bytes"] > 0 and by[1]["n_removed"] == 0
    assert by[None]["n_removed"] == 0 and by[3]["n_bytes"] == 0
    assert "source" in repeats.remove_repeats(long.withColumn("source", long.lang)).columns
    assert repeats.remove_repeats(none).count() == 0


def test_a_row_without_an_id_is_not_document_0(spark):
    """Windows of document 0 are asked for at the places where the row without an id has a passage that two larger documents share."""
    rng = random.Random(1)
    own, passage = letters(rng, 70), letters(rng, 70)
    docs = [(0, letters(rng, 60) + own + letters(rng, 60)), (9, letters(rng, 60) + own + letters(rng, 60)), (7, letters(rng, 90) + passage + letters(rng, 40)), (8, letters(rng, 40) + passage + letters(rng, 90))]
    unnamed = letters(rng, 60) + passage + letters(rng, 60)
    rows = spark.createDataFrame([(i, b.decode()) for i, b in [*docs, (None, unnamed)]], "doc_id long, text string")
    got = [tuple(r) for r in repeats.remove_repeats(rows, digest=True, carry=()).collect()]
    assert (None, len(unnamed), 0, 0, hashlib.sha256(unnamed).hexdigest()) in got
    want = brute(docs)
    assert sorted(r for r in got if r[0] is not None) == want and want[2][2] > 0 == want[1][2]

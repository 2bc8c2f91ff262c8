import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from millrace.llm import jaccard, simhash


def plain(text, k=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", "a", "a b", "A b C", "x y z x y z x", "é ü\x0bß\x1fq", " ".join(map(str, range(500)))])
def test_fingerprint(text):
    assert simhash.simhash(text) == plain(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    rng = random.Random(radius)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & differ == 0 for m in masks)
    for mask in masks[:3]:
        finer = simhash.split_masks(mask, radius)
        for _ in range(300):
            left = [b for b in range(64) if not mask >> b & 1]
            differ = sum(1 << b for b in rng.sample(left, radius))
            assert any(m & differ == 0 for m in finer)


@pytest.mark.parametrize("limit", [1024, 16])
def test_components_match_brute_force(spark, monkeypatch, limit):
    """With a small limit large buckets are split again."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
    rng = random.Random(9)
    fps = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for _ in range(40)]
    fps = list(dict.fromkeys(fps))
    classes = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    got = {r["node"]: r["root"] for r in simhash.connected_components(simhash.link_edges(classes, 3)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == components(fps, 3)


def test_chains_reach_the_smallest_node(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order[:-1], order[1:], strict=True)], "u long, v long")
    assert {r["root"] for r in simhash.connected_components(edges).collect()} == {0}


def test_awkward_rows(spark, awkward, none):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fp"] == by[4]["fp"] == by[5]["fp"] == 0 and by[5]["component_id"] == 3
    assert by[2]["component_id"] == 1 and by[None]["component_id"] == 1
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 6, 7, -8, None}
    assert simhash.near_duplicates(none).count() == 0


def test_a_row_that_shares_only_its_id_stays(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "quite other words that nobody else has at all"
    docs = spark.createDataFrame([(1, one, 1), (5, one, 2), (5, two, 3), (5, two, 3)], "doc_id long, text string, _fp int")
    for keep in (simhash.keep_one, jaccard.keep_one):
        assert sorted(tuple(r) for r in keep(docs).collect()) == [(1, one, 1), (5, two, 3), (5, two, 3)]


def test_query_on_small_table(spark, sf):
    got = simhash.op1_simhash_near_dedup(spark, sf).toPandas().sort_values("doc_id")
    texts = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    want = [plain(t) for t in texts.text]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in want]
    ids = texts.doc_id.to_numpy()
    assert got.component_id.tolist() == [ids[i] for i in components(want, 3)]
    assert np.all(got.component_id <= got.doc_id)


def test_wide_prints_by_their_definition():
    """A bit is set if it is in over half of the hashes, also of sets of more than 255; ties are not."""
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 4, 255, 256, 700, 5)]
    got = simhash.wide_prints(np.concatenate(sets), np.array([len(s) for s in sets]))
    for own, row in zip(sets, got, strict=True):
        for lane, salt in enumerate(simhash._LANES):
            bits = np.unpackbits(simhash.mix(own + salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            assert np.array_equal(np.unpackbits(row[lane : lane + 1].view(np.uint8), bitorder="little"), bits * 2 > len(own))
    assert simhash.wide_prints(np.zeros(0, np.uint64), np.zeros(0, np.int64)).shape == (0, 16)


def test_wide_prints_of_similar_sets_meet_and_are_close():
    """Sets of a similarity of exactly 0.8, of 4 to 5,000 hashes: one inside the other, and of equal size."""
    rng = np.random.default_rng(4)
    for both, one, other in [(4, 0, 1)] * 300 + [(8, 1, 1)] * 300 + [(80, 0, 20)] * 100 + [(80, 10, 10)] * 100 + [(4000, 500, 500)] * 20:
        h = rng.integers(0, 1 << 63, both + one + other, dtype=np.uint64)
        sets = [h[: both + one], np.concatenate((h[:both], h[both + one :]))]
        prints = simhash.wide_prints(np.concatenate(sets), np.array([len(s) for s in sets]))
        batch = pa.record_batch([pa.array([0, 1]), pa.array([p.tobytes() for p in prints], pa.binary()), pa.array([len(s) for s in sets])], names=["node", "print", "size"])
        table = pa.Table.from_batches(simhash._table_rows(iter([batch]))).sort_by("key")
        edges = pa.Table.from_batches(simhash._close_groups(iter(table.combine_chunks().to_batches())))
        assert {tuple(e.values()) for e in edges.to_pylist()} == {(0, 1)}


@pytest.mark.parametrize("paired", [2, 64])
def test_buckets_of_any_size_give_the_same_components(monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED_ROWS", paired)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (4, 3), dtype=np.uint64) & np.uint64((1 << 56) - 1)
    words = np.repeat(base, 10, axis=0) ^ (np.uint64(1) << rng.integers(0, 56, (40, 3), dtype=np.uint64))
    order = rng.permutation(40)
    u, v = simhash._bucket_edges(np.zeros(40, np.int64), order, np.ascontiguousarray(words[order].T))
    root = list(range(40))
    for _ in range(40):
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            root[a] = root[b] = min(root[a], root[b])
    assert root == [i // 10 * 10 for i in range(40)]


def test_edges_of_a_large_group_are_few(spark):
    """600 near copies meet in most tables; their edges do not grow with the pairs."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.concatenate((base, rng.integers(0, 1 << 63, 2, dtype=np.uint64))) for _ in range(600)]
    prints = simhash.wide_prints(np.concatenate(sets), np.full(600, 202))
    classes = spark.createDataFrame([(i, bytearray(p.tobytes()), 202) for i, p in enumerate(prints)], "node long, print binary, size long")
    edges = simhash.close_edges(classes)
    assert edges.count() < 1200
    assert {tuple(r) for r in simhash.connected_components(edges).collect()} == {(i, 0) for i in range(600)}

"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

Fingerprints are 64-bit SimHashes of word shingles.  Two fingerprints that differ in at
most `radius` bits must be linked.  Bit i gets a non-zero vector m(i) of radius + 1 bits, and
table v (one for each non-zero v) masks the fingerprint to the bits with <m(i), v> odd.  The
m(i) of up to `radius` differing bits span less than the whole space, so some v is orthogonal
to them all and its mask hides every difference: each pair within the radius meets in a table.

Exact copies share a fingerprint and are one class from the start, so a group of copies costs
one row.  A bucket of more than GROUP_ROWS classes is split again by the bits that its mask
left out: radius + 1 blocks of them, of which one at least is equal in both of any pair.  A
bucket whose open bits are so few that it cannot hold more than GROUP_ROWS classes ends this,
so no group is unbounded and none is cut off.

Similarities that 64 bits and a small radius cannot tell (a set similarity of 0.8 is one bit in
seven) take wide fingerprints, `wide_prints`: WIDE bits over the different shingles.  Each of TABLES
tables is keyed by KEY_BITS of them; two texts of similarity 0.8 miss all tables with a probability
of 1.4 in a million (random bits; that of two texts of 4 and 5 shingles, the worst, is 1.2 in a
hundred thousand, as texts of up to SMALL shingles have SMALL_TABLES more).  `close_edges` links what meets
in a table and differs in NEAR_BITS of CLOSE_BITS or fewer, which such a pair exceeds once in some
ten million.  What links is to be verified by the caller; nothing is cut off.

Nulls: a null text has no words (fingerprint zero).  A null doc_id keeps its fingerprint and
takes the component of its class, or null if no row of the class has an id.  Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import mix, read_table, trimmed
from millrace.storage import checkpoint

BITS = 64
GROUP_ROWS = 1024
SEED = 42
#: shingles whose bits are unpacked at once
BLOCK = 1 << 15
WIDE = 1024
TABLES, KEY_BITS = 160, 14
SMALL, SMALL_TABLES = 20, 96
#: bits compared in a bucket; the last byte of their words holds a class of the number of shingles
CLOSE_BITS, NEAR_BITS = 184, 58
#: sets of a similarity of 0.8 are at most five such classes apart
CLASS_STEP, CLASS_REACH = 1.05, 5
#: a bucket of more rows is searched row by row instead of by all pairs at once
PAIRED_ROWS = 64
_LANES = np.random.default_rng(20250302).integers(1, 1 << 63, WIDE // 64, dtype=np.uint64)
_PICKED = np.array([np.random.default_rng(i).choice(WIDE, KEY_BITS, replace=False) for i in range(TABLES + SMALL_TABLES)])


def simhash(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text: bit i is set if it is in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=False)), np.uint64)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return with_fingerprints(bare, shingle).select("doc_id", "fp")


def with_fingerprints(rows: DataFrame, shingle: int = 3) -> DataFrame:
    """rows, whose last column is the text, with their fingerprints as a last column fp."""
    n = len(rows.columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(x, shingle) for x in batch.column(n - 1).to_pylist()], np.uint64)
            yield pa.record_batch([*batch.columns, pa.array(found.view(np.int64))], names=[f"c{i}" for i in range(n + 1)])

    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema.fields)] + [T.StructField(f"c{n}", T.LongType())])
    return rows.mapInArrow(trimmed(each), schema).toDF(*rows.columns, "fp")


def wide_prints(grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The SimHash words of sets of shingle hashes that stand one after another, `size` of each (none is empty).

    A bit is set if it is in over half of a set's hashes.  Bits are counted eight at a time, in bytes of a word."""
    ends = np.cumsum(size)
    parts = -(-size // 255)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(ends - size, parts) + (np.arange(parts.sum()) - np.repeat(first, parts)) * 255
    out = np.zeros((len(size), WIDE // 64), np.uint64)
    if not len(size):
        return out
    low = np.uint64(0x0101010101010101)
    for lane, salt in enumerate(_LANES):
        bits = mix(grams + salt)
        votes = np.empty((len(size), 8, 8), np.int64)
        for i in range(8):
            counts = np.add.reduceat((bits >> np.uint64(i)) & low, cuts).view(np.uint8).reshape(-1, 8)
            votes[:, :, i] = counts if len(counts) == len(size) else np.add.reduceat(counts, first, axis=0, dtype=np.int64)
        over = votes.reshape(len(size), 64) * 2 > size[:, None]
        out[:, lane] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def table_keys(prints: np.ndarray) -> np.ndarray:
    """The key in each table, of the tables of small sets too; the table's number is above KEY_BITS."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
    keys = np.tile(np.arange(len(_PICKED), dtype=np.int64) << KEY_BITS, (len(prints), 1))
    for i in range(KEY_BITS):
        keys |= bits[:, _PICKED[:, i]].astype(np.int64) << i
    return keys


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, a, b, c) of (node, print, size), a row for each table."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            prints = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint64).reshape(-1, WIDE // 64)
            node, size = some.column(0).to_numpy(), some.column(2).to_numpy()
            keys = table_keys(prints)
            words = prints[:, :3].copy()
            step = np.minimum(np.log(size) / np.log(CLASS_STEP), 255).astype(np.uint64)
            words[:, 2] = (words[:, 2] & np.uint64((1 << 56) - 1)) | (step << np.uint64(56))
            row, table = np.nonzero((np.arange(keys.shape[1]) < TABLES) | (size <= SMALL)[:, None])
            columns = [keys[row, table], node[row], *(words[row, i].view(np.int64) for i in range(3))]
            yield pa.record_batch([pa.array(c) for c in columns], names=["key", "node", "a", "b", "c"])


def _close(words: np.ndarray, x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
    """Whether rows x and y of the words are alike in bits and in size."""
    other = words[2][x] ^ words[2][y]
    apart = (words[2][x] >> np.uint64(56)).astype(np.int64) - (words[2][y] >> np.uint64(56)).astype(np.int64)
    bits = np.bitwise_count(words[0][x] ^ words[0][y]).astype(np.int64) + np.bitwise_count(words[1][x] ^ words[1][y]) + np.bitwise_count(other << np.uint64(8))
    return (bits <= NEAR_BITS) & (np.abs(apart) <= CLASS_REACH)


def _bucket_edges(key: np.ndarray, node: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least node, node) of each component of what is close within a run of equal keys."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    least = node.copy()
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    end = np.repeat(start + size, size)
    at = np.flatnonzero(np.repeat(size <= PAIRED_ROWS, size))
    for shift in range(1, PAIRED_ROWS):
        at = at[at + shift < end[at]]
        if not len(at):
            break
        near = at[_close(words, at, at + shift)]
        xs.append(near)
        ys.append(near + shift)
    x, y = np.concatenate(xs), np.concatenate(ys)
    while (apart := least[x] != least[y]).any():
        both = np.minimum(least[x[apart]], least[y[apart]])
        np.minimum.at(least, x[apart], both)
        np.minimum.at(least, y[apart], both)
    for a, n in zip(start[size > PAIRED_ROWS].tolist(), size[size > PAIRED_ROWS].tolist(), strict=True):
        todo = np.arange(a, a + n)
        while len(todo):
            front, todo = [int(todo[0])], todo[1:]
            reached = list(front)
            while front and len(todo):
                near = _close(words, front.pop(), todo)
                found, todo = todo[near].tolist(), todo[~near]
                front += found
                reached += found
            least[reached] = node[reached].min()
    other = least != node
    return least[other], node[other]


def _close_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, a, b, c) come sorted by key."""
    held = [np.zeros(0, np.int64)] * 5

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        u, v = _bucket_edges(cols[0], cols[1], np.stack(cols[2:]).view(np.uint64))
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        cols = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[last:] for c in cols]
        if last:
            yield edges([c[:last] for c in cols])
    if len(held[0]):
        yield edges(held)


def close_edges(classes: DataFrame) -> DataFrame:
    """Edges (u, v), u < v, whose components hold all pairs that meet in a table and are close.

    A node has one edge of a table at most, to the least of its bucket's component; these are joined among themselves
    before, so that the edges are few in large groups too.
    classes has one row (node, print, size) for each set of shingles: its wide print and how many it has."""
    rows = classes.select("node", "print", F.col("size").cast("long")).mapInArrow(trimmed(_table_rows), "key long, node long, a long, b long, c long")
    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_close_groups), "u long, v long")
    stars = met.groupBy("v").agg(F.collect_set("u").alias("others")).select(F.array_min("others").alias("u"), F.explode(F.concat("others", F.array("v"))).alias("v"))
    return stars.filter("u <> v").distinct()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask for each non-zero v of radius + 1 bits."""
    full = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % full) & v).bit_count() % 2) for v in range(1, full + 1)]


def split_masks(mask: int, radius: int) -> list[int]:
    """The mask with one of radius + 1 blocks of its open bits added."""
    left = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in left[j :: radius + 1]) for j in range(radius + 1)]


def _linked(nodes: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(root, node) of the tree that joins what is within the radius, root smallest."""
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    todo = np.ones(len(nodes), bool)
    for i in np.argsort(nodes, kind="stable"):
        if not todo[i]:
            continue
        todo[i] = False
        reached = front = np.array([i])
        while len(front):
            front = np.flatnonzero(close[front].any(axis=0) & todo)
            todo[front] = False
            reached = np.concatenate((reached, front))
        if len(reached) > 1:
            yield np.full(len(reached) - 1, nodes[i]), nodes[reached[1:]]


def _link_groups(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (tag, key); a group has GROUP_ROWS rows at most."""
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4

        def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
            tag, key, node, fp = cols
            cut = np.flatnonzero(np.concatenate(([True], (tag[1:] != tag[:-1]) | (key[1:] != key[:-1]))))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            sizes = np.diff(np.append(cut, len(tag)))
            two = cut[sizes == 2]
            near = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius]
            found.append((np.minimum(node[near], node[near + 1]), np.maximum(node[near], node[near + 1])))
            for a, n in zip(cut[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                found += _linked(node[a : a + n], fp[a : a + n].view(np.uint64), radius)
            u, v = (np.concatenate([x[i] for x in found]) for i in (0, 1))
            return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            cols = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
            if not len(cols[0]):
                continue
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1:].sum() + 1) if ((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])).any() else 0
            held = [c[last:] for c in cols]
            if last:
                yield edges([c[:last] for c in cols])
        if len(held[0]):
            yield edges(held)

    return run


def link_edges(classes: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v), u < v, whose components are those of all pairs within the radius.

    classes has one row (fp, node) for each different fingerprint."""
    masks = covering_masks(radius)
    rows, out = classes, None
    level = {i: m for i, m in enumerate(masks)}
    keyed = rows.select("node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("tag", "key"))
    while True:
        sizes = checkpoint(keyed.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        joined = keyed.join(sizes, ["tag", "key"])
        # a bucket with few open bits has few classes, so the last level needs no split
        final = all(BITS - m.bit_count() <= (GROUP_ROWS - 1).bit_length() for m in level.values())
        small = joined if final else joined.filter(F.col("size") <= GROUP_ROWS)
        edges = (
            small.select(F.col("tag").cast("long").alias("tag"), "key", "node", "fp")
            .repartition("tag", "key")
            .sortWithinPartitions("tag", "key")
            .mapInArrow(trimmed(_link_groups(radius)), "u long, v long")
        )
        out = edges if out is None else out.unionByName(edges)
        if final or sizes.filter(F.col("size") > GROUP_ROWS).isEmpty():
            return out.distinct()
        finer = {t * (radius + 1) + j: m for t, mask in level.items() for j, m in enumerate(split_masks(mask, radius))}
        table = F.array(*[F.array(*[F.lit(signed(finer[t * (radius + 1) + j])) for j in range(radius + 1)]) for t in range(len(level))])
        keyed = (
            joined.filter(F.col("size") > GROUP_ROWS)
            .select("node", "fp", "tag", F.posexplode(table[F.col("tag")]).alias("j", "mask"))
            .select("node", "fp", (F.col("tag") * (radius + 1) + F.col("j")).cast("int").alias("tag"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        )
        level = finer


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node it can reach.

    Large-star and small-star steps alternate until the edges stay as they are; each step
    groups by a pre-aggregated minimum and joins it back, so no star has to fit in a task."""
    current, before = checkpoint(edges.select("u", "v").filter("u <> v")), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before or not state[0]:
            return current.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(current.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
        before = tuple(state)
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()  # a > b
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        current = checkpoint(small.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct())


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    prints = checkpoint(fingerprints(docs, text, shingle))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    known = classes.filter("node is not null")
    roots = connected_components(link_edges(known, radius))
    labels = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs that have the smallest id of their component (rows without an id stay).

    Rows go by id and fingerprint: a row stays that shares only its id with one that goes."""
    found = near_duplicates(docs, text, shingle, radius)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    marked = with_fingerprints(docs.toDF(*names).withColumn("_text", F.col(at[text]).cast("string")), shingle)
    kept = marked.join(gone, (F.col(at["doc_id"]).cast("long") == gone["_id"]) & (marked["fp"] == gone["_fp"]), "left_anti")
    return kept.select(*names).toDF(*docs.columns)


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Proportional stratified interleaving into shards.

Rows are shuffled within each source by a seeded hash, ranked, and sorted over all sources by
fractional rank (rank less a phase of the source, over the source's rows).  Any run of the
result has the mixture of the whole, so equal cuts give shards that match it.  The law is
"rows": shards differ by one row at most.

Exact ranks need no ordering of a whole source in one task: rows go to buckets of hash range
(within a source) and then of fractional rank, both of about `bucket_rows` rows; counts of the
buckets give offsets by prefix sums, and row numbers are taken within a bucket only.  The phase
keeps sources of one row from all having the same fractional rank.

Nulls: a null text has no bytes, a null source is a source of its own, a null doc_id is a value
like any other.  Equal rows are interchangeable, so ties give one defined set of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import read_table
from millrace.storage import checkpoint

SHARDS = 40
SEED = 2024
OVERHEAD_BYTES = 16
BUCKET_ROWS = 20_000
_HEX = 15


def _hash(*parts) -> F.Column:
    """A hash under 2**60 that other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, _HEX), 16, 10).cast("long")


def interleave(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, source: str = "source", bucket_rows: int = BUCKET_ROWS, carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot) of every row; with carry, the row itself as a last column `row`."""
    extra = ["row"] if carry else []
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("stratum"),
        *([F.struct(*docs.columns).alias("row")] if carry else []),
    ).withColumn("h", _hash(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    rows = checkpoint(rows)
    n = rows.count()
    buckets = max(1, -(-n // bucket_rows))
    rows = rows.withColumn("bucket", F.floor(F.col("h") / F.lit(float(1 << 4 * _HEX)) * buckets).cast("int"))
    order = ["h", "doc_id", "size", "text_crc32"]

    # rank in the source: rows of earlier buckets, and the place in the own one
    whole = Window.partitionBy("stratum")
    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select(
        "stratum",
        "bucket",
        (F.sum("c").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"),
        F.sum("c").over(whole).alias("of"),
    )
    rank = F.col("before") + F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*order))
    phase = (F.conv(F.substring(F.md5("stratum"), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    ranked = rows.join(offsets, ["stratum", "bucket"]).withColumn("at", (rank - phase) / F.col("of"))
    ranked = checkpoint(ranked.select("doc_id", "size", "text_crc32", "stratum", "h", "at", *extra).withColumn("band", F.floor(F.col("at") * buckets).cast("int")))

    # place in the whole, in the same way
    bands = ranked.groupBy("band").agg(F.count(F.lit(1)).alias("c"))
    bands = bands.select("band", (F.sum("c").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("band").orderBy("at", "stratum", *order)) - 1
    placed = ranked.join(bands, "band").withColumn("place", place)
    shard = F.expr(f"place * {n_shards} div {max(n, 1)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - F.expr(f"(cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}")).cast("long").alias("slot"),
        *extra,
    )


def write_shards(docs: DataFrame, path: str, tasks: int | None = None, **options) -> None:
    """Every row once, in the folder of its shard, with its slot; files hold runs of slots in order.

    Tasks take ranges of (shard, slot), so a shard is as many tasks' work as its rows need.  A column
    of docs that is named shard or slot is written with an underscore before its name."""
    placed = interleave(docs, carry=True, **options)
    names = list(docs.columns)
    for new in ("shard", "slot"):
        if new in names:
            other = new
            while other in names:
                other = "_" + other
            names[names.index(new)] = other
    rows = placed.select("shard", "slot", *[F.col(f"row.{c}").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    tasks = tasks or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), options.get("n_shards", SHARDS))
    rows.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return interleave(read_table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))

"""Point-in-time joins and reads of the latest row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.spec import DEFAULTS, FEATURE_NAMES, FEATURES


#: the table's time is cut into blocks of this length where a key's rows are dealt over tasks
BLOCK_SECONDS = 86_400
#: rows of a key, of both sides, from which a join takes the form in blocks
HOT_ROWS = 500_000


def _both_sides(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], created: str | None) -> DataFrame:
    """Right rows (_side 0) and left rows (_side 1) as one table.  A right row without a time is never at or before anything."""
    row = F.struct(F.col(right_ts).cast("timestamp").alias("_at"), *[F.col(c) for c in values])
    empty = F.lit(None).cast(left.sparkSession.createDataFrame([], right.select(row.alias("r")).schema).schema["r"].dataType)
    late = F.col(created).cast("timestamp") if created else F.lit(None).cast("timestamp")
    facts = right.filter(F.col(right_ts).isNotNull()).select(F.col(key), F.col(right_ts).cast("timestamp").alias("_ts"), F.lit(0).alias("_side"), late.alias("_created"), row.alias("_row"))
    asks = left.select(F.col(key), F.col(left_ts).cast("timestamp").alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast("timestamp").alias("_created"), empty.alias("_row"), F.struct(*left.columns).alias("_left"))
    return facts.unionByName(asks, allowMissingColumns=True)


def _with_values(found: DataFrame, right: DataFrame, values: list[str], ttl_seconds: int | None) -> DataFrame:
    fresh = F.lit(True) if ttl_seconds is None else F.unix_micros("_found._at") >= F.unix_micros("_ts") - ttl_seconds * 1_000_000
    return found.select("_left.*", *[F.when(fresh, F.col(f"_found.{c}")).cast(right.schema[c].dataType).alias(c) for c in values])


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], created: str | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time.

    Equal right times are told apart by `created`.  With a time to live, older right rows count
    as absent.  Both sides go through one exchange and sort by key; no row of the left is lost."""
    both = _both_sides(left, right, key, left_ts, right_ts, values, created)
    upto = Window.partitionBy(key).orderBy("_ts", "_side", "_created").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_row", ignorenulls=True).over(upto)).filter("_side = 1")
    return _with_values(found, right, values, ttl_seconds)


def asof_join_balanced(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], created: str | None = None, ttl_seconds: int | None = None, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """The same rows for keys of very many rows: a key's time is cut into blocks, and each block is a task's work by itself.

    Where a block has no right row up to the left one, the last right row of the blocks before
    counts, which comes from one pre-aggregated row for each key and block."""
    both = _both_sides(left, right, key, left_ts, right_ts, values, created)
    both = both.withColumn("_block", F.floor(F.unix_seconds("_ts") / block_seconds))
    newest = F.max_by("_row", F.when(F.col("_side") == 0, F.struct("_ts", "_created")))
    ends = both.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_b")).agg(newest.alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_b", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    upto = Window.partitionBy(key, "_block").orderBy("_ts", "_side", "_created").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_inside", F.last("_row", ignorenulls=True).over(upto)).filter("_side = 1")
    met = inside.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_b")), "left")
    return _with_values(met.withColumn("_found", F.coalesce("_inside", "_carried")), right, values, ttl_seconds)


def asof_join_by_size(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], created: str | None = None, ttl_seconds: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same rows, by the form that the largest key asks for; its rows are counted before anything moves."""
    sizes = left.select(key).unionByName(right.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    join = asof_join_balanced if most > hot_rows else asof_join
    return join(left, right, key, left_ts, right_ts, values, created, ttl_seconds)


def lost_rows(left: DataFrame, joined: DataFrame, id_column: str) -> DataFrame:
    """Rows of the left side that the join lost; a training set with any is refused."""
    return left.join(joined, id_column, "left_anti")


def latest_per_key(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last row of each key by (ts, tie), by a pre-aggregated maximum."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_row"))
    return best.select(key, "_row.*").select(*rows.columns)


def unambiguous_last(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The last rows of keys whose last time is not tied."""
    whole = Window.partitionBy(key)
    last = rows.withColumn("_max", F.max(ts).over(whole)).filter(F.col(ts) == F.col("_max"))
    return last.withColumn("_n", F.count(F.lit(1)).over(whole)).filter("_n = 1").drop("_max", "_n")


def lookup(requests: DataFrame, store: DataFrame, key: str = "card_id", at: Column | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """Requests with the stored features of their key; a key that is not stored has every default and found = false.

    With a time to live, a row committed longer than that before `at` (seconds, a column of the requests) counts as absent."""
    stored = store.select(key, F.lit(True).alias("_found"), *(["committed_ts"] if ttl_seconds is not None else []), *FEATURE_NAMES)
    asked = requests if ttl_seconds is None else requests.withColumn("_at", at)
    joined = asked.join(stored, key, "left")
    if ttl_seconds is not None:
        fresh = F.col("committed_ts") >= F.col("_at") - ttl_seconds
        joined = joined.withColumns({c: F.when(fresh, F.col(c)) for c in ("_found", *FEATURE_NAMES)})
    filled = [F.coalesce(F.col(f.name), F.lit(DEFAULTS[f.name])).cast(f.spark_type).alias(f.name) for f in FEATURES]
    return joined.select(*requests.columns, F.coalesce("_found", F.lit(False)).alias("found"), *filled)

"""Streaming jobs over wire messages: landing, features, and the upsert of the latest rows.

Messages come from files (`messages`) or from Kafka (`kafka_messages`, where Spark has the
connector); both give the columns value and arrival, and the jobs take either."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from millrace.operators.store import latest_versions, store_view
from millrace.operators.windows import seconds
from millrace.sources.events import from_wire, read_landing, rejected, to_wire, valid
from millrace.spec import FEATURE_NAMES
from millrace.streaming.state import keyed_features

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


# ---- sources and sinks of messages ------------------------------------------------------------


def produce(events: DataFrame, path: str, files: int = 4) -> None:
    """Events as files of wire messages, each card in one file and in time order (what a topic keyed by card gives).

    A column `arrival` of the events is their order of arrival in place of time."""
    wire = to_wire(events)
    wire.repartition(files, "key").sortWithinPartitions("value").select("value").write.mode("append").text(path)


def messages(spark: SparkSession, path: str, max_files: int = 2) -> DataFrame:
    """Messages of text files; their arrival is the field of that name, or 0."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).text(path)
    return lines.withColumn("arrival", F.coalesce(F.get_json_object("value", "$.arrival").cast("long"), F.lit(0)))


def kafka_messages(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None, starting: str = "earliest", **options: str) -> DataFrame:
    """Messages of a topic; a card's messages are in one partition, so their offsets are its order of arrival."""
    reader = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting} | options)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return from_kafka(reader.load())


def from_kafka(records: DataFrame) -> DataFrame:
    return records.select(F.col("value").cast("string").alias("value"), F.col("offset").cast("long").alias("arrival"))


def produce_kafka(events: DataFrame, servers: str, topic: str) -> None:
    """Wire messages to a topic, keyed by card."""
    to_wire(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def end_offsets(query: StreamingQuery) -> list[dict]:
    """The source offsets that a query has reached, one entry for each source."""
    last = query.lastProgress
    return [{"source": s["description"], "offset": s["endOffset"]} for s in last["sources"]] if last else []


# ---- running ----------------------------------------------------------------------------------


class Progress(StreamingQueryListener):
    """Totals of every batch of the queries that are watched, and of their observed metrics."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.metrics: dict[str, dict[str, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        self.rows[run] = self.rows.get(run, 0) + p.numInputRows
        self.batches[run] = self.batches.get(run, 0) + 1
        for row in p.observedMetrics.values():
            total = self.metrics.setdefault(run, {})
            for name, value in row.asDict().items():
                total[name] = total.get(name, 0) + (value or 0)

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))


def _run(spark: SparkSession, writers: list, idle_seconds: float | None) -> tuple[list[dict[str, int]], list[StreamingQuery]]:
    """Start queries and wait: until all there is has been read, or until nothing came for idle_seconds."""
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        trigger = {"availableNow": True} if idle_seconds is None else {"processingTime": "200 milliseconds"}
        queries = [w.trigger(**trigger).start() for w in writers]
        if idle_seconds is None:
            for q in queries:
                q.awaitTermination()
        else:
            seen, since = -1, time.monotonic()
            while all(q.isActive for q in queries) and time.monotonic() - since < idle_seconds:
                now = sum(progress.rows.values())
                if now != seen:
                    seen, since = now, time.monotonic()
                time.sleep(0.2)
            for q in queries:
                q.stop()
                if q.exception():
                    raise q.exception()
        runs = [str(q.runId) for q in queries]
        deadline = time.monotonic() + 10
        while not progress.ended.issuperset(runs) and time.monotonic() < deadline:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(progress)
    return [{"consumed": progress.rows.get(r, 0), "batches": progress.batches.get(r, 0)} | progress.metrics.get(r, {}) for r in runs], queries


def land_stream(spark: SparkSession, source: str | DataFrame, landing: str, rejects: str, checkpoint: str, idle_seconds: float | None = None) -> dict:
    """Valid events to the landing folder, others with their reason beside it; exactly once by the sinks' own logs."""
    parsed = from_wire(messages(spark, source) if isinstance(source, str) else source)
    counts = [F.count(F.lit(1)).alias("read"), F.count("reject").alias("malformed"), F.count(F.when(F.col("reject").isNull(), 1)).alias("written")]
    writers = [
        valid(parsed.observe("wire", *counts)).writeStream.format("parquet").option("path", landing).option("checkpointLocation", f"{checkpoint}/landing"),
        rejected(parsed).writeStream.format("parquet").option("path", rejects).option("checkpointLocation", f"{checkpoint}/rejects"),
    ]
    (totals, _), queries = _run(spark, writers, idle_seconds)
    return {"malformed": 0, "written": 0} | {n: x for n, x in totals.items() if n != "read"} | {"offsets": end_offsets(queries[0])}


class LatestStore:
    """Latest rows by card: a base and the changes since, as numbered folders of a table.

    A batch writes its own rows only, and what is read is the latest of base and changes; after
    COMPACT changes a new base is written whole.  A folder's name tells the job and batch that made
    it, so a batch that is run again finds its rows there and adds nothing; numbers go on from the
    greatest, whatever job writes.  The folder before the newest base stays for readers of it."""

    COMPACT = 8

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def folders(self) -> list[tuple[int, str, str]]:
        """(number, "base" or "change", name) of complete folders."""
        path, fs, root = self._files()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        found = [(int(n.split("-")[1]), n.split("-")[0], n) for n in names if n.startswith(("base-", "change-"))]
        return sorted(f for f in found if fs.exists(path(f"{self.path}/{f[2]}/_SUCCESS")))

    def _current(self) -> list[tuple[int, str, str]]:
        found = self.folders()
        base = max((n for n, kind, _ in found if kind == "base"), default=-1)
        return [f for f in found if f[0] >= base]

    def read(self) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/{name}").withColumn("_version", F.lit(n)) for n, _, name in self._current()]
        if not parts:
            return None
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return latest_versions(whole, "_version")

    def upsert(self, rows: DataFrame, batch: int, job: str = "job") -> None:
        """Collapse to the latest row of each card and add it; the first batch of a job is read back and checked."""
        mark = f"{hashlib.sha256(job.encode()).hexdigest()[:16]}-{batch}"
        found = self.folders()
        if any(name.endswith(f"-{mark}") for _, _, name in found):
            return
        fresh = rows.groupBy("card_id").agg(F.max_by(F.struct("committed_ts", *FEATURE_NAMES), F.struct("committed_ts", "txn_count_lifetime")).alias("r")).select("card_id", "r.*")
        number = max((n for n, *_ in found), default=-1) + 1
        target = f"{self.path}/change-{number:09d}-{mark}"
        fresh.write.mode("overwrite").parquet(target)
        if batch == 0:
            missing = self.spark.read.parquet(target).filter(" or ".join(f"{n} is null" for n in ["committed_ts", *FEATURE_NAMES])).count()
            if missing:
                raise ValueError(f"{missing} stored rows have null features")
        if len(self._current()) > self.COMPACT:
            self.compact(number + 1)

    def compact(self, number: int) -> None:
        before = self._current()
        self.read().write.mode("overwrite").parquet(f"{self.path}/base-{number:09d}-compact")
        # a batch that is run again must still find its mark, so the newest change of the old folders stays
        old = [f for f in self.folders() if f[0] < before[0][0]]
        path, fs, _ = self._files()
        for _, _, name in old:
            fs.delete(path(f"{self.path}/{name}"), True)


def _setting(spark: SparkSession, name: str, value: str) -> Callable[[], None]:
    """Set it, and return what sets it back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    return lambda: spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def features_stream(
    spark: SparkSession, source: str | DataFrame, store: str, scoring: str, checkpoint: str, policy: str = "watermark", release_ms: int | None = None, idle_seconds: float | None = None
) -> dict:
    """Scoring rows appended to a table, store rows upserted, until all is read or nothing comes for idle_seconds.

    Counts: messages consumed and malformed, batches, rows scored and pushed, cards released by a timer, late events."""
    back = _setting(spark, _PROVIDER, ROCKSDB)
    try:
        parsed = from_wire(messages(spark, source) if isinstance(source, str) else source, "arrival")
        events = valid(parsed.observe("wire", F.count("reject").alias("malformed")), "arrival").withColumn("u", seconds("event_timestamp"))
        latest = LatestStore(spark, store)
        totals = dict.fromkeys(("scored", "pushed", "released"), 0)

        def write(batch: DataFrame, number: int) -> None:
            batch.persist()
            batch.filter("view = 'scoring'").write.mode("overwrite").parquet(f"{scoring}/batch={number}")
            rows = batch.filter("view <> 'scoring'")
            latest.upsert(rows.withColumnRenamed("u", "committed_ts").select("card_id", "committed_ts", *FEATURE_NAMES), number, checkpoint)
            for view, n in batch.groupBy("view").count().collect():
                totals[{"scoring": "scored", "store": "pushed", "released": "released"}[view]] += n
            batch.unpersist()

        writer = keyed_features(events, policy, False, release_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
        (found,), queries = _run(spark, [writer], idle_seconds)
    finally:
        back()
    late = spark.read.parquet(scoring).groupBy("card_id").agg(F.max("late").alias("n")).agg(F.sum("n")).first()[0] if totals["scored"] else 0
    return {"malformed": 0} | found | totals | {"late": late or 0, "offsets": end_offsets(queries[0])}


def finalized(spark: SparkSession, store: LatestStore, landing: str) -> DataFrame:
    """The store with every landed event folded in: a full replay, which also repairs what was still waiting."""
    return store_view(read_landing(spark, landing))

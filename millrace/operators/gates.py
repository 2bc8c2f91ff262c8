"""Reports, alerts and verification gates over DataFrames."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import drift, metrics, parity, store, windows
from millrace.streaming.state import keyed_features

log = logging.getLogger("millrace")
SEVERITIES = ("info", "warning", "critical")


@dataclass(frozen=True)
class Gate:
    name: str
    passed: bool
    detail: str
    seconds: float


def timed(name: str, check: Callable[[], tuple[bool, str]]) -> Gate:
    """The outcome of a check; an exception is a failure."""
    start = time.perf_counter()
    try:
        passed, detail = check()
    except Exception as error:  # noqa: BLE001
        passed, detail = False, f"{type(error).__name__}: {error}"
    return Gate(name, bool(passed), detail[:500], round(time.perf_counter() - start, 3))


def write_report(spark: SparkSession, rows: list[dict] | DataFrame, path: str) -> None:
    """A small report as JSON lines; NaN and infinities are null."""
    if isinstance(rows, DataFrame):
        rows.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)
        return
    clean = [json.dumps({k: None if isinstance(v, float) and v - v != 0 else v for k, v in r.items()}) for r in rows]
    spark.createDataFrame([(x,) for x in clean], "value string").coalesce(1).write.mode("overwrite").text(path)


def modified(spark: SparkSession, path: str) -> int | None:
    """Time of change in milliseconds, or None if there is nothing at path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    return fs.getFileStatus(target).getModificationTime() if fs.exists(target) else None


def fresh_report(spark: SparkSession, report: str, data: str) -> DataFrame:
    """A report that is not older than the data it is about; else an error."""
    made, changed = modified(spark, report), modified(spark, data)
    if made is None or changed is None:
        raise FileNotFoundError(report if made is None else data)
    if made < changed:
        raise ValueError(f"{report} is older than {data}; make it again")
    return spark.read.json(report)


def fire(title: str, body: str, severity: str = "warning", send: Callable[[dict], None] | None = None) -> bool:
    """Log an alert and pass it to `send` if there is one; a failing `send` is logged and never raised."""
    if severity not in SEVERITIES:
        severity = "warning"
    log.log({"info": logging.INFO, "warning": logging.WARNING, "critical": logging.CRITICAL}[severity], "%s: %s", title, body)
    try:
        if send:
            send({"title": title, "body": body, "severity": severity})
        return True
    except Exception:  # noqa: BLE001
        log.exception("the alert was not sent")
        return False


def write_label_csv(df: DataFrame, path: str, columns: list[str], label: str = "is_fraud") -> None:
    """Headerless files with the label first."""
    df.select(label, *columns).write.mode("overwrite").csv(path, header=False)


def same_rows(left: DataFrame, right: DataFrame) -> tuple[bool, str]:
    """Whether two tables have the same rows, repeats included."""
    a, b = left.count(), right.count()
    missing, extra = left.exceptAll(right).count(), right.exceptAll(left).count()
    return a == b and not missing and not extra, f"{a} and {b} rows, {missing} missing, {extra} extra"


def parity_gate(events: DataFrame) -> tuple[bool, str]:
    """The state machine agrees with the batch form under the watermark policy, and must not under the arrival policy."""
    rows = events.withColumn("u", windows.seconds("event_timestamp"))
    offline = windows.trailing_features(events)
    held, seen = (parity.row_report(offline, keyed_features(rows, p, finalize=True).filter("view = 'scoring'")).first() for p in ("watermark", "arrival"))
    return held["passed"] and not seen["passed"], f"watermark: {held['n_mismatch']} of {held['n_rows']} differ; arrival: {seen['n_mismatch']}"


def recovery_gate(events: DataFrame, stored: DataFrame, report: str | None = None, spot_cards: int = 20, seed: int = 7) -> tuple[bool, str]:
    """A full replay gives the stored rows, and so do the folded last events of seeded cards; the outcome is written as a report."""
    found = parity.row_report(store.store_view(events), stored, "card_id").first()
    spot = store.spot_check(events, stored, spot_cards, seed).filter("n_differ > 0").count()
    if report:
        write_report(events.sparkSession, [{"n_cards": found["n_rows"], "n_mismatch": found["n_mismatch"], "spot_differ": spot}], report)
    return found["passed"] and not spot, f"{found['n_mismatch']} of {found['n_rows']} cards differ; {spot} of {spot_cards} asked"


def served_report(served: DataFrame, offline: DataFrame, stored: DataFrame, events: DataFrame, spot_cards: int = 20, seed: int = 7) -> DataFrame:
    """One row: served rows against offline ones (nulls and NaN differ from everything), rows that only one side has, and the
    spot check of seeded cards' last events folded into their offline rows against the store."""
    rows = parity.row_report(offline, served, nan_equal=False).select("n_rows", "n_mismatch", F.col("only_left").alias("only_offline"), F.col("only_right").alias("only_served"))
    spot = store.spot_check(events, stored, spot_cards, seed).agg(F.count(F.lit(1)).alias("spot_cards"), F.count(F.when(F.col("n_differ") > 0, 1)).alias("spot_differ"))
    whole = rows.crossJoin(F.broadcast(spot))  # one row each
    none = [F.col(c) == 0 for c in ("n_mismatch", "only_offline", "only_served", "spot_differ")]
    return whole.withColumn("passed", none[0] & none[1] & none[2] & none[3])


def served_gate(served: DataFrame, offline: DataFrame, stored: DataFrame, events: DataFrame) -> tuple[bool, str]:
    found = served_report(served, offline, stored, events).first()
    return found["passed"], str(found.asDict())


def model_gate(scored: DataFrame, factor: float = 2.0) -> tuple[bool, str]:
    """Average precision of the scores passes `factor` times that of the amount alone."""
    own, base = (metrics.ranking_metrics(scored, c, "is_fraud").first()["average_precision"] for c in ("score", "amount"))
    return own > factor * base, f"{own:.4f} against {base:.4f} of the amount"


def latency_gate(samples: DataFrame, value: str = "ms", most: float = 50.0) -> tuple[bool, str]:
    p95 = metrics.latency_profile(samples, value).first()["p95"]
    return p95 < most, f"p95 {p95:.2f}"


def drift_gate(events: DataFrame) -> tuple[bool, str]:
    found = drift.experiment_passes(drift.drift_experiment(events)).first()
    return found["passed"], str(found.asDict())


def run_gates(gates: dict[str, Callable[[], tuple[bool, str]]]) -> list[Gate]:
    return [timed(name, check) for name, check in gates.items()]


def as_rows(gates: list[Gate]) -> list[dict]:
    return [asdict(g) for g in gates]


def validated_requests(requests: DataFrame, most: int = 500) -> DataFrame:
    """Scoring requests with a reject reason; a batch over the limit is refused as a whole."""
    n = requests.count()
    if n > most:
        raise ValueError(f"{n} requests in one batch; at most {most}")
    top_k = F.coalesce(F.col("top_k"), F.lit(5)) if "top_k" in requests.columns else F.lit(5)
    reason = F.when(F.col("card_id").isNull(), "missing card").when(F.col("amount").isNull() | (F.col("amount") < 0), "bad amount").when(~top_k.between(1, 20), "bad top_k")
    return requests.withColumn("reject", reason)

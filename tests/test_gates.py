"""Gates, reports, alerts, requests and the command line."""

import pytest
from pyspark.sql import functions as F

from millrace.__main__ import main
from millrace.operators import gates, store
from millrace.sources.events import synthetic


@pytest.fixture(scope="module")
def events(spark):
    return synthetic(spark, n_cards=10, n_events=250, seed=17, duplicate_ts_rate=0.3).cache()


def test_exceptions_are_failures():
    found = gates.run_gates({"good": lambda: (True, "fine"), "bad": lambda: 1 / 0})
    assert [g.passed for g in found] == [True, False] and "ZeroDivisionError" in found[1].detail


def test_parity_and_recovery(spark, events):
    assert gates.parity_gate(events)[0]
    assert gates.recovery_gate(events, store.store_view(events))[0]
    assert not gates.recovery_gate(events, store.store_view(events.filter("transaction_id > 40")))[0]


def test_reports_must_be_fresh(spark, tmp_path):
    data, report = str(tmp_path / "data"), str(tmp_path / "report")
    spark.range(1).write.parquet(data)
    gates.write_report(spark, [{"a": 1, "b": float("nan")}], report)
    assert gates.fresh_report(spark, report, data).first()["a"] == 1
    with pytest.raises(FileNotFoundError):
        gates.fresh_report(spark, report, str(tmp_path / "none"))
    import os

    os.utime(report, (1, 1))
    with pytest.raises(ValueError, match="older"):
        gates.fresh_report(spark, report, data)


def test_alerts_never_raise():
    sent = []
    assert gates.fire("t", "b", "critical", sent.append) and sent[0]["severity"] == "critical"
    assert not gates.fire("t", "b", "odd", lambda _: 1 / 0)


def test_model_and_latency_gates(spark):
    rows = spark.range(200).select(F.col("id").alias("transaction_id"), (F.col("id") % 50 == 0).cast("int").alias("is_fraud"), F.rand(1).alias("amount"), (F.col("id") % 50 == 0).cast("double").alias("score"))
    assert gates.model_gate(rows)[0]
    assert gates.latency_gate(spark.createDataFrame([(1.0,), (49.0,)], "ms double"))[0] and not gates.latency_gate(spark.createDataFrame([(51.0,)], "ms double"))[0]


def test_requests(spark):
    rows = spark.createDataFrame([("a", 1.0, 5), ("b", -1.0, 5), (None, 1.0, 5), ("c", 1.0, 99)], "card_id string, amount double, top_k int")
    assert [r["reject"] for r in gates.validated_requests(rows).collect()] == [None, "bad amount", "missing card", "bad top_k"]
    with pytest.raises(ValueError, match="at most 3"):
        gates.validated_requests(rows, 3)


def test_same_rows(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert gates.same_rows(a, a.repartition(2))[0] and not gates.same_rows(a, a.distinct())[0]


def test_command_line(spark, tmp_path):
    made, out = str(tmp_path / "events"), str(tmp_path / "features")
    assert main(["prepare", "--events", "4000", "--out", made]) == 0
    assert main(["features", "--events", made, "--out", out]) == 0 and spark.read.parquet(out).count() == 4000
    assert main(["parity", "--events", made, "--out", str(tmp_path / "report")]) == 0


def test_label_csv(spark, tmp_path):
    gates.write_label_csv(spark.createDataFrame([(1, 2.5)], "is_fraud int, amount double"), str(tmp_path / "csv"), ["amount"])
    assert spark.read.text(str(tmp_path / "csv")).first()[0] == "1,2.5"

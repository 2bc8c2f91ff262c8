"""Scoring of requests, snapshots, served-window drift, gates over served rows, models and their registry."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import asof, dataset, drift, gates, metrics, model, ordered, serving, store, windows
from millrace.sources.events import synthetic
from millrace.spec import DEFAULTS, FEATURE_NAMES, MODEL_INPUTS
from millrace.storage import checkpoint


@pytest.fixture(scope="module")
def events(spark):
    return synthetic(spark, n_cards=12, n_events=500, seed=9, duplicate_ts_rate=0.1).cache()


@pytest.fixture(scope="module")
def stored(events):
    return store.store_view(events).cache()


def requests(spark, at, rows):
    made = [(i, c, at + later, 50.0, p, None, "debit", None, 1.0, None) for i, (c, later, p) in enumerate(rows)]
    df = spark.createDataFrame(made, "transaction_id long, card_id string, u long, amount double, product_cd string, card_network string, card_type string, email_domain string, addr1 double, dist1 double")
    return df.withColumn("event_timestamp", F.timestamp_seconds("u")).drop("u")


def test_requests_get_every_input(spark, events, stored):
    one = stored.first()
    last = one["committed_ts"]
    asked = requests(spark, last, [(one["card_id"], 100, "C"), ("nobody", 100, "?"), (one["card_id"], dataset.TTL_SECONDS + 1, "W")])
    rows = {r["transaction_id"]: r for r in serving.request_rows(asked, stored).collect()}
    assert set(MODEL_INPUTS) <= set(serving.request_rows(asked, stored).columns)
    assert rows[0]["found"] and rows[0]["seconds_since_last_txn"] == 100 and rows[0]["txn_count_7d"] == one["txn_count_7d"]
    assert not rows[1]["found"] and all(rows[1][n] == DEFAULTS[n] for n in FEATURE_NAMES)
    assert (rows[1]["product_cd"], rows[1]["card_network"], rows[1]["seconds_since_last_txn"]) == ("W", "unknown", -1)
    assert not rows[2]["found"]  # the stored row has outlived its time
    assert {r["transaction_id"]: r["found"] for r in serving.request_rows(asked, stored, ttl_seconds=None).collect()}[2]


def test_contributions_add_up(spark, stored):
    weights = {"amount": 0.02, "txn_count_7d": -0.1, "addr1": 0.5}
    asked = requests(spark, 1_512_100_000, [("nobody", 0, "W"), ("card_00001", 0, "W")])
    scored = model.explained(serving.score_requests(asked, stored, model.linear_scorer(weights, -1.0, {"amount": 10.0})), weights, 2).collect()
    for r in scored:
        parts = r["contributions"].asDict()
        assert r["score"] == pytest.approx(1 / (1 + 2.718281828459045 ** -(sum(parts.values()) - 1.0)))
        assert [t["feature"] for t in r["top"]] == [n for n, _ in sorted(parts.items(), key=lambda x: (-abs(x[1]), x[0]))[:2]]
        assert r["flagged"] == (r["score"] >= 0.5)


def test_snapshot_decays_without_new_events(spark, events, stored):
    one = stored.filter("txn_count_7d > 0").first()
    at = [one["committed_ts"], one["committed_ts"] + 604_800, 0]
    asked = spark.createDataFrame([(one["card_id"], t) for t in at] + [("nobody", at[0])], "card_id string, at long")
    rows = {(r["card_id"], r["at"]): r for r in store.snapshot_at(events, asked).collect()}
    assert len(rows) == 4
    assert rows[one["card_id"], at[0]]["txn_count_7d"] == one["txn_count_7d"] and rows[one["card_id"], at[0]]["amt_sum_7d"] == pytest.approx(one["amt_sum_7d"])
    assert rows[one["card_id"], at[1]]["txn_count_7d"] == 0 and rows[one["card_id"], at[1]]["txn_count_lifetime"] == one["txn_count_lifetime"]
    assert all(rows[k][n] == DEFAULTS[n] for k in ((one["card_id"], 0), ("nobody", at[0])) for n in FEATURE_NAMES)


def test_served_report_finds_each_kind_of_fault(spark, events, stored):
    offline = windows.trailing_features(events)
    whole = gates.served_report(offline.select("transaction_id", *FEATURE_NAMES), offline, stored, events, 5).first()
    assert whole["passed"] and whole["n_rows"] == 500 and whole["spot_cards"] == 5
    bad = offline.filter("transaction_id <> 1").withColumn("amt_sum_1h", F.when(F.col("transaction_id") == 2, float("nan")).otherwise(F.col("amt_sum_1h")))
    bad = bad.unionByName(offline.filter("transaction_id = 3").withColumn("transaction_id", F.lit(9999).cast("long")))
    lost = stored.withColumn("txn_count_lifetime", F.col("txn_count_lifetime") + 1)
    got = gates.served_report(bad, offline, lost, events, 5).first()
    assert (got["n_mismatch"], got["only_offline"], got["only_served"], got["spot_differ"], got["passed"]) == (1, 1, 1, 5, False)


def test_spot_check_leaves_out_tied_cards(spark, events, stored):
    got = store.spot_check(events, stored, 1000).collect()
    alone = {r["card_id"] for r in asof.unambiguous_last(events, "card_id", "event_timestamp").collect()}
    assert {r["card_id"] for r in got} == alone and all(r["n_differ"] == 0 for r in got)


def test_recovery_gate_writes_its_report(spark, events, stored, tmp_path):
    passed, _ = gates.recovery_gate(events, stored, str(tmp_path / "r"))
    assert passed and spark.read.json(str(tmp_path / "r")).first()["n_mismatch"] == 0
    assert not gates.recovery_gate(events, stored.withColumn("txn_count_7d", F.lit(0).cast("long")))[0]


def test_served_drift_of_a_shifted_window(spark, events):
    offline = windows.trailing_features(events)
    made = offline.withColumn("u", windows.seconds("event_timestamp")).select("transaction_id", "u", *FEATURE_NAMES)
    reference = offline.withColumns(drift.ondemand())
    window = drift.served_window(made, events.filter("transaction_id > 1"), 100)
    assert window.count() == 100 and set(drift.MONITORED) <= set(window.columns)
    calm = {r["column"]: r["score"] for r in drift.served_drift(made, events, reference, 500).collect()}
    assert max(calm.values()) < 1e-9
    loud = drift.served_drift(made.withColumn("amt_mean_24h", F.col("amt_mean_24h") * 4), events, reference, 500)
    assert [r["column"] for r in loud.filter("drifted").collect() if r["column"] == "amt_mean_24h"]


def test_verdicts_go_by_method(spark):
    rows = [("a", "K-S p_value", 0.01, 0.05), ("b", "K-S p_value", 0.2, 0.05), ("c", "Wasserstein distance (normed)", 0.2, 0.1), ("d", "PSI", None, 0.1)]
    found = spark.createDataFrame(rows, "column string, method string, value double, threshold double")
    assert {r["column"]: r["drifted"] for r in drift.verdict(found).collect()} == {"a": True, "b": False, "c": True, "d": None}
    with pytest.raises(ValueError, match="no column"):
        drift.verdict(found.filter("column = 'd'"))


def test_quantiles_are_exact(spark):
    rng = random.Random(1)
    values = [rng.choice([1.5, 2.0, rng.random() * 100]) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    got = ordered.quantiles(df, "x", [0.0, 0.25, 0.5, 0.95, 0.999, 1.0])
    import numpy as np

    assert got == pytest.approx(np.quantile(values, [0.0, 0.25, 0.5, 0.95, 0.999, 1.0]).tolist())
    assert ordered.quantiles(df.filter("x is null"), "x", [0.5]) == [None]


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_running_sums_by_group_with_the_next_value(spark, ranges):
    rng = random.Random(ranges)
    points = {(g, x): rng.randrange(5) for g, scale in (("a", 1.0), ("b", 1e6)) for x in {round(rng.random() * scale, 6) for _ in range(300)}}
    df = spark.createDataFrame([(g, x, n) for (g, x), n in points.items()], "g string, x double, n long").repartition(3)
    got = {(r["g"], r["x"]): (r["s"], r["next"]) for r in ordered.running_sums(df, "x", {"s": "n"}, within="g", following="next", ranges=ranges).collect()}
    for g in "ab":
        total, xs = 0, sorted(x for h, x in points if h == g)
        for x, after in zip(xs, [*xs[1:], None], strict=True):
            total += points[g, x]
            assert got[g, x] == (total, after)


def test_no_window_of_the_statistics_takes_a_whole_column(spark, events):
    """Row-wise windows go by range; only the one row of each range is ordered as a whole."""
    plan = drift.drift_scores(windows.trailing_features(events), windows.trailing_features(events), ["amount"])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "windowspecdefinition(column" in line:
            assert "_range" in line
    wide = metrics.latency_profile(checkpoint(events), "amount")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in wide


def test_training_run_registers_the_winner(spark, events, tmp_path):
    rows = dataset.training_set(events.withColumn("is_fraud", (F.col("amount") > 60).cast("int"))).cache()
    options = {"gbt": model.grid(maxIter=[2], maxDepth=[2, 3]), "logistic": [{"maxIter": 5}], "forest": [{"numTrees": 3}]}
    registry = str(tmp_path / "models")
    report = model.training_run(rows, options, registry)
    assert report["winner"] == max(report["validation"], key=report["validation"].get) and set(report["validation"]) == set(options)
    assert report["version"] == 1 and report["test"]["average_precision"] > report["baselines"]["random_ap"]
    assert report["importance"][0][0] == "amount"
    fitted, meta = model.latest(spark, registry)
    assert model.register(spark, fitted, meta["categories"], registry) == 2 and model.versions(spark, registry) == [1, 2]
    again = model.score(rows, fitted, meta["categories"], meta["threshold"])
    assert again.columns == [*rows.columns, "score", "flagged"] and again.count() == rows.count()
    with pytest.raises(FileNotFoundError):
        model.latest(spark, str(tmp_path / "none"))
    asked = requests(spark, 1_512_100_000, [("card_00001", 0, "W")])
    scored = serving.score_requests(asked, store.store_view(events), model.scorer(fitted, meta["categories"])).first()
    assert 0 <= scored["score"] <= 1 and scored["product_cd"] == "W"


def test_dead_columns_and_wide_categories_are_refused(spark, events, monkeypatch):
    from millrace.functions import features

    with pytest.raises(ValueError, match="email_domain"):
        dataset.no_dead_columns(events, ["amount", "email_domain"])
    assert dataset.no_dead_columns(events, ["amount"]) is events
    monkeypatch.setattr(features, "MOST_CATEGORIES", 2)
    with pytest.raises(ValueError, match="product_cd"):
        features.category_map(events)


def test_training_set_is_written_once(events, tmp_path):
    path = str(tmp_path / "t")
    assert dataset.write_training_set(events, path).count() == dataset.write_training_set(events.limit(0), path).count() == 500


def test_latency_histogram_is_cumulative(spark):
    samples = spark.createDataFrame([("a", x) for x in (0.5, 1.0, 3.0, 9999.0, None)], "stage string, ms double")
    got = {r["le"]: r["n"] for r in serving.latency_histogram(samples, by="stage").collect()}
    assert got[1.0] == 2 and got[2.5] == 2 and got[5.0] == 3 and got[2500.0] == 3 and got[None] == 4

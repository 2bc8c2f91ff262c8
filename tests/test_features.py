"""Request-time features, encodings, splits, metrics, parity, drift, models."""

import math
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from millrace import spec
from millrace.functions import features as fx
from millrace.operators import asof, dataset, drift, metrics, model, parity, windows
from millrace.operators.ordered import running_sums
from millrace.sources.events import synthetic


@pytest.fixture(scope="module")
def events(spark):
    return synthetic(spark, n_cards=20, n_events=600, seed=13).cache()


def test_ondemand_cold_start_and_request_clock(spark):
    stored = {n: spec.DEFAULTS[n] for n in spec.FEATURE_NAMES}
    rows = [stored | {"amount": 500.0, "product_cd": "W", "now": 1}, stored | {"amount": 10.0, "product_cd": "C", "now": 1100, "last_txn_unixtime": 1000.0, "txn_count_7d": 4, "product_C_count_7d": 1, "amt_mean_24h": 5.0, "amt_max_7d": 0.000001}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))
    cold, warm = df.select(*[c.alias(n) for n, c in fx.ondemand(F.col("now")).items()]).collect()
    assert tuple(cold) == (0.0, 0.0, 0.0, -1.0)
    assert math.isclose(warm["amt_over_mean_24h"], 10 / 5.000001) and warm["amt_over_max_7d"] == 1000.0 and warm["product_freq_7d"] == 0.25 and warm["seconds_since_last_txn"] == 100.0


def test_encoding(spark):
    maps = {"product_cd": ["C", "H", "R", "S", "W"], "card_network": ["discover", "mastercard", "other", "visa"]}
    df = spark.createDataFrame([("W", "visa", None), ("Q", None, 2.0)], "product_cd string, card_network string, dist1 double")
    a, b = fx.encode(df, maps).collect()
    assert tuple(a) == (4, 3, 0.0) and tuple(b) == (-1, -1, 2.0)


def test_finite_and_json_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in df.select(fx.finite(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 2.0]
    assert [r[0] for r in df.select(fx.json_number(F.col("x"))).collect()] == [None, None, None, 2.0]


def test_top_contributions(spark):
    df = spark.createDataFrame([(1.0, -3.0, 2.0)], "a double, b double, c double")
    got = df.select(fx.top_contributions({n: F.col(n) for n in "abc"}, 2).alias("t")).first()["t"]
    assert [(x["feature"], x["contribution"]) for x in got] == [("b", -3.0), ("c", 2.0)]


@pytest.mark.parametrize("join", [asof.asof_join, partial(asof.asof_join_balanced, block_seconds=70), asof.asof_join_balanced, asof.asof_join_by_size, partial(asof.asof_join_by_size, hot_rows=4)])
def test_asof_ties_ttl_and_no_lost_rows(spark, join):
    left = spark.createDataFrame([(1, "a", 100), (2, "a", 50), (3, "b", 100), (4, "a", 1000)], "id int, k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    right = spark.createDataFrame([("a", 60, 1, 1.0), ("a", 60, 2, 2.0), ("a", 100, 1, 3.0)], "k string, t long, c long, v double").select("k", F.timestamp_seconds("t").alias("at"), F.timestamp_seconds("c").alias("created"), "v")
    got = {r["id"]: r["v"] for r in join(left, right, "k", "ts", "at", ["v"], "created", 500).collect()}
    assert got == {1: 3.0, 2: None, 3: None, 4: None}
    early = {r["id"]: r["v"] for r in join(left.filter("t = 100").withColumn("ts", F.timestamp_seconds(F.lit(99))), right, "k", "ts", "at", ["v"], "created").collect()}
    assert early == {1: 2.0, 3: None}


@pytest.mark.parametrize(("most", "form"), [(3, "asof_join_balanced"), (4, "asof_join")])
def test_the_largest_key_decides_the_form(spark, monkeypatch, most, form):
    taken = []
    for name in ("asof_join", "asof_join_balanced"):
        monkeypatch.setattr(asof, name, lambda left, *a, name=name: taken.append(name) or left)
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], "k string, t long")
    asof.asof_join_by_size(rows, rows, "k", "t", "t", ["t"], hot_rows=most)
    asof.asof_join_by_size(rows.limit(0), rows.limit(0), "k", "t", "t", ["t"], hot_rows=most)
    assert taken == [form, "asof_join"]


@pytest.mark.parametrize("block", [1, 30, 10_000])
def test_asof_forms_agree_with_brute_force(spark, block):
    rng = random.Random(block)
    keys, times = ["a", "a", "a", "b", None], [None, *range(0, 300, 7)]
    asks = [(i, rng.choice(keys), rng.choice(times)) for i in range(120)]
    facts = [(rng.choice(keys[:4]), rng.choice(times), i, float(i)) for i in range(60)]
    left = spark.createDataFrame(asks, "id int, k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    right = spark.createDataFrame(facts, "k string, t long, c long, v double").select("k", F.timestamp_seconds("t").alias("at"), F.timestamp_seconds("c").alias("created"), "v")
    want = {}
    for i, k, t in asks:
        seen = [f[1:] for f in facts if t is not None and f[0] == k and f[1] is not None and f[1] <= t]
        want[i] = max(seen)[2] if seen else None
    for join in (asof.asof_join, partial(asof.asof_join_balanced, block_seconds=block)):
        got = join(left, right, "k", "ts", "at", ["v"], "created").collect()
        assert len(got) == len(asks) and {r["id"]: r["v"] for r in got} == want
    none = asof.asof_join_balanced(left, right.limit(0), "k", "ts", "at", ["v"], "created", block_seconds=block).collect()
    assert len(none) == len(asks) and {r["v"] for r in none} == {None}
    assert asof.asof_join_balanced(left.limit(0), right, "k", "ts", "at", ["v"]).count() == 0


def test_split_positions_with_ties(spark):
    rows = [(i, "c", 1000 + i // 7, 0) for i in range(100)]
    df = spark.createDataFrame(rows, "transaction_id long, card_id string, t long, is_fraud int").withColumn("event_timestamp", F.timestamp_seconds("t"))
    got = {r["transaction_id"]: r["split"] for r in dataset.chronological_split(df).collect()}
    assert [got[i] for i in range(100)] == ["train"] * 70 + ["valid"] * 15 + ["test"] * 15
    assert dataset.chronological_split(df.limit(0)).count() == 0


def test_training_set_loses_nothing(spark, events):
    built = dataset.training_set(events, dataset.feature_table(events))
    assert dataset.checked(events, built).count() == 600
    with pytest.raises(ValueError, match="no row"):
        dataset.checked(events, built.filter("transaction_id > 5"))
    direct = dataset.training_set(events)
    assert direct.exceptAll(built).count() == 0


def test_running_sums_match_a_plain_order(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(40)), 1) for _ in range(300)]
    points = spark.createDataFrame(rows, "x double, n int").groupBy("x").agg(F.sum("n").alias("n"))
    total, want = 0, {}
    for x in sorted({r[0] for r in rows}, reverse=True):
        total += sum(r[0] == x for r in rows)
        want[x] = total
    assert {r["x"]: r["s"] for r in running_sums(points, "x", {"s": "n"}, descending=True, ranges=5).collect()} == want


def test_ranking_metrics(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(200)]
    got = metrics.ranking_metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, before = 0.0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, n = sum(s >= t and y for s, y in rows), sum(s >= t for s, _ in rows)
        ap, before = ap + (tp / len(pos) - before) * tp / n, tp / len(pos)
    assert math.isclose(got["roc_auc"], auc) and math.isclose(got["average_precision"], ap)


def test_latency_of_pooled_samples(spark):
    a, b = spark.createDataFrame([(1.0,), (2.0,)], "ms double"), spark.createDataFrame([(3.0,), (10.0,)], "ms double")
    got = metrics.merged_latency([a, b], "ms").first()
    assert got["p50"] == 2.5 and got["max"] == 10.0 and got["n"] == 4


def test_parity_reports_examples(spark, events):
    full = windows.trailing_features(events)
    off = full.withColumn("txn_count_7d", F.col("txn_count_7d") + (F.col("transaction_id") < 9).cast("int"))
    row = parity.feature_report(full, off).filter("n_mismatch > 0").collect()
    assert [r["feature"] for r in row] == ["txn_count_7d"] and row[0]["examples"] == [1, 2, 3, 4, 5] and row[0]["max_abs_diff"] == 1.0


def test_constant_columns_count_null_as_a_value(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 2, "x")], "a int, b int, c string")
    assert {r["column"]: r["is_constant"] for r in dataset.constant_columns(df, ["a", "b", "c"]).collect()} == {"a": True, "b": False, "c": True}


def test_drift_is_quiet_on_halves_and_alerts_on_shifts(spark):
    rows = synthetic(spark, n_cards=60, n_events=4000, seed=101)
    base = drift.feature_tail(rows, "none", 1.0).cache()
    one, two = drift.halves(base)
    quiet = drift.drift_decision(drift.drift_scores(one, two)).first()
    assert not quiet["alerted"] and quiet["severity"] == "quiet"
    for kind in ("amount", "velocity", "product"):
        assert drift.drift_decision(drift.drift_scores(base, drift.feature_tail(rows, kind, 1.0))).first()["alerted"], kind


def test_velocity_compresses_gaps(spark, events):
    before, after = (dataset.median_gap(x).first()[0] for x in (events, drift.inject_shift(events, "velocity")))
    assert after <= before / 15
    with pytest.raises(ValueError, match="shift"):
        drift.inject_shift(events, "sideways")


def test_model_fit_score_save_load(spark, events, tmp_path):
    split = dataset.chronological_split(dataset.training_set(events)).cache()
    train = split.filter("split = 'train'")
    maps = fx.category_map(train)
    fitted = model.fit(train, maps, maxIter=2, maxDepth=2)
    scored = model.score(split.filter("split = 'test'"), fitted, maps)
    assert scored.count() == 90 and scored.filter("score < 0 or score > 1").count() == 0
    model.save(fitted, maps, str(tmp_path))
    again, meta = model.load(str(tmp_path))
    assert meta["categories"] == maps and model.importance(again)[0][1] >= 0
    with pytest.raises(ValueError, match="model type"):
        model.fit(train, maps, "guess")


def test_dead_columns_are_found_without_distinct_values(spark):
    rows = [(1, None, "x", None, 0.5), (1, None, "x", 2, float("nan")), (1, None, "y", 2, 0.5)]
    df = spark.createDataFrame(rows, "a int, b string, c string, d int, e double")
    known = {r["column"] for r in dataset.constant_columns(df, df.columns).filter("is_constant").collect()}
    with pytest.raises(ValueError) as found:
        dataset.no_dead_columns(df, df.columns)
    assert known == {"a", "b"} and "['a', 'b']" in str(found.value)
    assert dataset.no_dead_columns(df, ["c", "d", "e"]) is df

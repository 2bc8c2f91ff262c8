"""Trailing windows: three forms agree with a brute force over rows, and with micro-cases."""

import math
from functools import partial

import pytest
from pyspark.sql import functions as F

from millrace import spec
from millrace.operators import windows
from millrace.sources.events import synthetic
from millrace.storage import checkpoint

COLUMNS = "transaction_id long, card_id string, event_timestamp timestamp, amount double, product_cd string"


def make(spark, rows):
    """rows of (card, seconds, amount, product)."""
    data = [(i + 1, c, t, float(a), p) for i, (c, t, a, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "transaction_id long, card_id string, t long, amount double, product_cd string")
    return df.withColumn("event_timestamp", F.timestamp_seconds("t")).drop("t").select("transaction_id", "card_id", "event_timestamp", "amount", "product_cd")


def brute(events):
    out = {}
    for e in events:
        mine = [x for x in events if x["card_id"] == e["card_id"]]
        u = int(e["event_timestamp"].timestamp())
        seen = [(int(x["event_timestamp"].timestamp()), x["amount"], x["product_cd"] if x["product_cd"] in spec.PRODUCTS else "W") for x in mine]
        seen = [x for x in seen if x[0] < u]
        row = {"last_txn_unixtime": max((x[0] for x in seen), default=-1), "txn_count_lifetime": len(seen)}
        for w, n in spec.WINDOWS.items():
            inside = [x for x in seen if x[0] > u - n]
            row[f"txn_count_{w}"] = len(inside)
            row[f"amt_sum_{w}"] = sum(x[1] for x in inside)
            row[f"amt_mean_{w}"] = row[f"amt_sum_{w}"] / len(inside) if inside else 0.0
            row[f"amt_max_{w}"] = max((x[1] for x in inside), default=0.0)
        for p in spec.PRODUCTS:
            row[f"product_{p}_count_7d"] = sum(x[2] == p and x[0] > u - 604800 for x in seen)
        out[e["transaction_id"]] = row
    return out


@pytest.fixture(scope="module")
def generated(spark):
    return synthetic(spark, n_cards=12, n_events=400, seed=11, duplicate_ts_rate=0.3).cache()


@pytest.mark.parametrize("form", [windows.trailing_features, windows.trailing_features_balanced, partial(windows.trailing_features_by_size, hot_events=30), windows.trailing_features_by_size])
def test_matches_brute_force(generated, form):
    rows = [r.asDict() for r in generated.collect()]
    want = brute(rows)
    got = form(generated).collect()
    assert len(got) == len(rows)
    for r in got:
        for name in spec.FEATURE_NAMES:
            assert math.isclose(r[name], want[r["transaction_id"]][name], rel_tol=1e-9, abs_tol=1e-6), name


def test_edges_of_the_open_interval(spark):
    t = 1_600_000_000
    rows = [("a", t, 1, "W"), ("a", t + 3600, 2, "W"), ("b", t, 3, "W"), ("b", t + 3599, 4, "W"), ("c", t, 5, "W"), ("c", t, 6, "C"), ("c", t, 7, "Q")]
    got = {r["transaction_id"]: r for r in windows.trailing_features(make(spark, rows)).collect()}
    assert got[2]["txn_count_1h"] == 0 and got[2]["txn_count_24h"] == 1 and got[2]["amt_sum_24h"] == 1.0 and got[2]["amt_max_1h"] == 0.0
    assert got[4]["txn_count_1h"] == 1
    assert {got[i]["txn_count_7d"] for i in (5, 6, 7)} == {0} and {got[i]["last_txn_unixtime"] for i in (5, 6, 7)} == {-1.0}


def test_unknown_products_count_as_w_and_negative_maxima_stay(spark):
    t = 1_600_000_000
    got = windows.trailing_features(make(spark, [("a", t, -5, "Q"), ("a", t + 10, 1, "W")])).orderBy("transaction_id").collect()[1]
    assert got["product_W_count_7d"] == 1 and got["amt_max_1h"] == -5.0
    assert windows.trailing_features_balanced(make(spark, [("a", t, -5, "Q"), ("a", t + 10, 1, "W")])).orderBy("transaction_id").collect()[1]["amt_max_1h"] == -5.0


def test_events_without_a_card_are_one_card_in_every_form(spark):
    t = 1_600_000_000
    events = make(spark, [(None, t, 1, "W"), ("a", t + 5, 2, "C"), (None, t + 10, 4, "W"), (None, t + 604800, 8, "H")])
    want = [tuple(r) for r in windows.trailing_features(events).orderBy("transaction_id").collect()]
    assert [r[events.columns.index("transaction_id")] for r in want] == [1, 2, 3, 4]
    for form in (windows.trailing_features_balanced, windows.range_join_features, partial(windows.trailing_features_by_size, hot_events=1)):
        assert [tuple(r) for r in form(events).orderBy("transaction_id").collect()] == want


def test_arrival_differs_only_where_times_tie(spark, generated):
    strict = {r["transaction_id"]: r for r in windows.trailing_features(generated).collect()}
    seen = {r["transaction_id"]: r for r in windows.arrival_features(generated).collect()}
    tied = {r["transaction_id"] for r in windows.tie_rank(generated).filter("tie_rank > 0").collect()}
    differ = {i for i in strict if strict[i]["txn_count_lifetime"] != seen[i]["txn_count_lifetime"]}
    assert differ == tied and tied
    other = {r["transaction_id"]: r for r in windows.arrival_features(generated, form=partial(windows.trailing_features_by_size, hot_events=30)).collect()}
    assert all(math.isclose(other[i][n], seen[i][n], rel_tol=1e-9, abs_tol=1e-6) for i in seen for n in spec.FEATURE_NAMES)


@pytest.mark.parametrize("most", [0, windows.BROADCAST_CARDS])
def test_cards_are_dealt_by_their_events(spark, monkeypatch, most):
    monkeypatch.setattr(windows, "BROADCAST_CARDS", most)
    taken = {}
    for name in ("trailing_features", "trailing_features_balanced"):
        made = getattr(windows, name)
        monkeypatch.setattr(windows, name, lambda events, *a, name=name, made=made: taken.update({name: {r[0] for r in events.select("card_id").distinct().collect()}}) or made(events, *a))
    t = 1_600_000_000
    events = make(spark, [("a", t + i, i, "W") for i in range(5)] + [("b", t, 1, "W"), (None, t, 1, "W")])
    assert windows.trailing_features_by_size(events, hot_events=4).count() == 7
    assert taken == {"trailing_features": {"b", None}, "trailing_features_balanced": {"a"}}


def test_empty_input_keeps_types(spark):
    got = windows.trailing_features(spark.createDataFrame([], COLUMNS))
    assert got.count() == 0 and [got.schema[f.name].dataType for f in spec.FEATURES] == [f.spark_type for f in spec.FEATURES]


def test_missing_columns_are_named(spark):
    with pytest.raises(KeyError, match="amount"):
        windows.trailing_features(spark.createDataFrame([], COLUMNS).drop("amount"))


def test_one_exchange_for_all_frames(generated):
    # the generator has an exchange of its own
    plan = windows.trailing_features(checkpoint(generated))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_spec_contract():
    assert len(spec.FEATURE_NAMES) == len(set(spec.FEATURE_NAMES)) == 19
    assert len(spec.MODEL_INPUTS) == 31 and "last_txn_unixtime" not in spec.MODEL_INPUTS and len(spec.MONITORED) == 23
    assert not set(spec.FEATURE_NAMES) & set(spec.ONDEMAND)

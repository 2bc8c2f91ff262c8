"""The keyed state machine: policies, late events, timers' folding, and agreement with the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import spec
from millrace.operators import parity, store, windows
from millrace.sources.events import synthetic
from millrace.streaming import jobs
from millrace.streaming.state import CardState, keyed_features

NAMES = spec.FEATURE_NAMES


def values(card, now, closed=True):
    return dict(zip(NAMES, card.features(now, closed), strict=True))


def test_eviction_counts_and_sums():
    card = CardState()
    card.see(0, 100.0, "W", "watermark")
    got = dict(zip(NAMES, card.see(7200, 1.0, "W", "watermark"), strict=True))
    assert (got["txn_count_1h"], got["txn_count_24h"], got["amt_sum_24h"], got["amt_max_1h"]) == (0, 1, 100.0, 0.0)


def test_nothing_is_committed_until_a_newer_event_or_the_end():
    card = CardState()
    card.see(100, 5.0, "W", "watermark")
    assert card.last is None
    card.fold()
    assert card.last == 100 and values(card, 100)["txn_count_lifetime"] == 1


def test_clocks_are_per_card():
    slow, fast = CardState(), CardState()
    slow.see(1000, 1.0, "W", "arrival")
    fast.see(9_000_000, 1.0, "W", "arrival")
    slow.see(2000, 1.0, "W", "arrival")
    assert slow.last == 2000 and fast.last == 9_000_000


def test_late_events_are_counted_and_kept():
    card = CardState()
    card.see(2000, 1.0, "W", "arrival")
    card.see(1000, 1.0, "W", "arrival")
    assert card.late == 1 and card.born == 2
    waiting = CardState()
    waiting.see(2000, 1.0, "W", "watermark")
    waiting.see(1000, 1.0, "W", "watermark")  # only a waiting event is newer
    assert waiting.late == 1


def test_ties_do_not_see_each_other_under_the_watermark():
    card = CardState()
    first = card.see(50, 1.0, "W", "watermark")
    second = card.see(50, 2.0, "W", "watermark")
    assert first == second
    other = CardState()
    assert other.see(50, 1.0, "W", "arrival") != other.see(50, 2.0, "W", "arrival")


def test_trim_keeps_what_windows_can_reach():
    card = CardState()
    for u in (0, 10, 604_800, 604_811):
        card.see(u, 1.0, "W", "arrival")
    card.trim()
    assert [e[0] for e in card.kept] == [604_800, 604_811] and card.born == 4


@pytest.fixture(scope="module")
def events(spark):
    return synthetic(spark, n_cards=10, n_events=300, seed=5, duplicate_ts_rate=0.3).cache()


def test_watermark_agrees_with_batch_and_arrival_does_not(spark, events):
    rows = events.withColumn("u", windows.seconds("event_timestamp"))
    offline = windows.trailing_features(events)
    online = keyed_features(rows, "watermark", finalize=True).filter("view = 'scoring'")
    assert parity.row_report(offline, online).first()["passed"]
    assert parity.feature_report(offline, online).filter("n_mismatch > 0").count() == 0
    assert not parity.row_report(offline, keyed_features(rows, "arrival", finalize=True).filter("view = 'scoring'")).first()["passed"]


def test_store_rows_are_the_batch_store_view(spark, events):
    rows = events.withColumn("u", windows.seconds("event_timestamp"))
    online = keyed_features(rows, "watermark", finalize=True).filter("view = 'store'").select("card_id", *NAMES)
    assert parity.row_report(store.store_view(events), online, "card_id").first()["passed"]


def test_unknown_policy_is_refused(spark, events):
    with pytest.raises(ValueError, match="policy"):
        keyed_features(events.withColumn("u", windows.seconds("event_timestamp")), "hopeful")


def test_small_and_large_amounts_are_not_rounded(spark):
    """Amounts under any unit are summed, and a large one leaves no trace when it has left the window."""
    rows = [(i, "a", 1_512_100_000 + 60 * i, 0.00004) for i in range(3)] + [(3, "b", 1_512_100_000, 1e12)] + [(4 + i, "b", 1_512_104_000 + 60 * i, 0.01) for i in range(3)]
    events = spark.createDataFrame([(i, c, u, x, "W") for i, c, u, x in rows], "transaction_id long, card_id string, u long, amount double, product_cd string")
    events = events.withColumn("event_timestamp", F.timestamp_seconds("u"))
    want = {0: 0.0, 1: 0.00004, 2: 0.00008, 3: 0.0, 4: 0.0, 5: 0.01, 6: 0.02}
    forms = {
        "frames": windows.trailing_features(events),
        "blocks": windows.trailing_features_balanced(events),
        "pairs": windows.range_join_features(events),
        "state": keyed_features(events, "watermark", finalize=True).filter("view = 'scoring'"),
    }
    for name, made in forms.items():
        got = {r["transaction_id"]: (r["amt_sum_1h"], r["amt_sum_24h"]) for r in made.collect()}
        assert {i: x for i, (x, _) in got.items()} == pytest.approx(want, abs=1e-15), name
        assert got[6][1] == pytest.approx(1e12 + 0.02, abs=1e-3), name
    held = {r["card_id"]: r["amt_sum_1h"] for r in store.store_view(events).collect()}
    assert held == pytest.approx({"a": 0.00012, "b": 0.03}, abs=1e-15)


def plain(events, now, closed):
    out = {}
    for name, length in spec.WINDOWS.items():
        inside = [a for t, a, _ in events if now - length < t and (t <= now if closed else t < now)]
        out |= {f"txn_count_{name}": len(inside), f"amt_sum_{name}": sum(inside), f"amt_max_{name}": max(inside, default=0.0)}
    for p in spec.PRODUCTS:
        out[f"product_{p}_count_7d"] = sum(c == p and now - 604_800 < t and (t <= now if closed else t < now) for t, _, c in events)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_running_totals_match_a_plain_sum(seed):
    """In order and late, over gaps of all sizes, with the state saved and loaded in between."""
    rng = random.Random(seed)
    card, seen, t = CardState(), [], 0
    for i in range(120):
        t += rng.choice([0, 0, 10, 1800, 3600, 3601, 90_000, 300_000])
        u = t if rng.random() < 0.85 else max(0, t - rng.choice([5, 4000, 100_000]))
        event = (u, round(rng.random() * 100, 2), rng.choice(spec.PRODUCTS))
        got = dict(zip(NAMES, card.see(*event, "arrival"), strict=True))
        want = plain(seen, u, True)
        if u >= max((e[0] for e in seen), default=0):
            assert {n: got[n] for n in want} == pytest.approx(want)
        seen.append(event)
        if i % 17 == 0:
            card.trim()
            card = CardState(card.kept, card.waiting, card.last, card.born, card.late)


def test_late_rows_inside_a_batch_are_counted(spark):
    rows = [("a", 2000, 1, 1.0, "W", 1), ("a", 1000, 2, 1.0, "W", 2), ("a", 3000, 3, 1.0, "W", 3)]
    events = spark.createDataFrame(rows, "card_id string, u long, transaction_id long, amount double, product_cd string, arrival long")
    for policy in ("watermark", "arrival"):
        got = {r["transaction_id"]: r["late"] for r in keyed_features(events, policy, finalize=True).filter("view = 'scoring'").collect()}
        assert got == {1: 0, 2: 1, 3: 1}, policy
    sorted_ = keyed_features(events.drop("arrival"), "arrival", finalize=True).agg(F.max("late")).first()[0]
    assert sorted_ == 0


def test_idle_cards_are_released_by_a_timer(spark, tmp_path):
    """What waits for a newer event that never comes reaches the store after release_ms."""
    base = str(tmp_path)
    events = synthetic(spark, n_cards=4, n_events=40, seed=5, duplicate_ts_rate=0.3)
    jobs.produce(events, f"{base}/wire", files=2)
    ran = jobs.features_stream(spark, f"{base}/wire", f"{base}/store", f"{base}/scoring", f"{base}/check", release_ms=500, idle_seconds=12)
    n = events.select("card_id").distinct().count()
    assert ran["consumed"] == 40 and ran["released"] >= n
    held = jobs.LatestStore(spark, f"{base}/store").read()
    assert parity.row_report(store.store_view(events), held, "card_id").first()["passed"]

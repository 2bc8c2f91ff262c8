"""Sources, sinks, wire messages, streaming jobs."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import dataset, parity, store, windows
from millrace.sources import events as source
from millrace.sources.events import synthetic
from millrace.spec import EVENT_COLUMNS, FEATURE_NAMES, FEATURES
from millrace.streaming import jobs


@pytest.fixture(scope="module")
def events(spark):
    return source.synthetic(spark, n_cards=8, n_events=200, seed=3, duplicate_ts_rate=0.2).cache()


def test_generator_is_the_same_for_any_partitioning(spark, events):
    again = source.synthetic(spark, n_cards=8, n_events=200, seed=3, duplicate_ts_rate=0.2).repartition(3)
    assert events.exceptAll(again).count() == 0 and events.select("transaction_id").distinct().count() == 200
    assert events.filter("amount < 0 or addr1 is null").count() == 0


def test_generator_has_ties_and_refuses_unknown_shifts(spark, events):
    assert events.groupBy("event_timestamp").count().filter("count > 1").count() > 0
    with pytest.raises(ValueError, match="shift"):
        source.synthetic(spark, shift="sideways")


def test_csv_with_nulls_and_other_columns(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(
        "isFraud,extra,TransactionID,TransactionDT,TransactionAmt,ProductCD,card1,card4,card6,P_emaildomain,addr1,dist1\n"
        "1,x,7,60,12.5,ZZZ,,visa,,a.com,,3\n0,y,8,61,1,H,33,,credit,,5.0,\n"
    )
    got = [r.asDict() for r in source.canonical(source.read_raw_csv(spark, str(tmp_path / "raw.csv"))).orderBy("transaction_id").collect()]
    assert got[0]["card_id"] == "card_-1" and got[0]["product_cd"] == "W" and got[0]["card_type"] == "unknown" and got[0]["addr1"] is None
    assert got[1]["card_id"] == "card_33" and got[1]["product_cd"] == "H" and got[1]["card_network"] == "unknown" and got[1]["dist1"] is None
    (tmp_path / "bad.csv").write_text("TransactionID\n1\n")
    with pytest.raises(KeyError, match="TransactionDT"):
        source.read_raw_csv(spark, str(tmp_path / "bad.csv"))


def test_wire_round_trip_and_rejects(spark, events):
    back = source.valid(source.from_wire(source.to_wire(events)))
    assert back.exceptAll(events.select(*EVENT_COLUMNS)).count() == 0 and back.count() == 200
    texts = ['{"transaction_id": 1, "card_id": "c", "event_timestamp": "2020-01-01T00:00:00", "amount": -1.0}', "{", '{"amount": 3}', '{"transaction_id": 2, "card_id": "c", "event_timestamp": "2020-01-01T00:00:00", "amount": 1, "product_cd": "ZZZ", "more": 1}']
    parsed = source.from_wire(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert {r["reject"] for r in source.rejected(parsed).collect()} == {"negative amount", "malformed", "missing field"}
    assert source.valid(parsed).first()["product_cd"] == "W"


def test_landing_counts_an_event_once(spark, events, tmp_path):
    path = str(tmp_path / "landing")
    source.land(events, path)
    source.land(events.limit(20), path)
    assert source.read_landing(spark, path).count() == 200


def test_missing_events_say_so(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no events"):
        source.load_events(spark, str(tmp_path / "nothing"))


def test_cached_or_built(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    assert source.cached_or_built(spark, path, build).count() == 3 and source.cached_or_built(spark, path, build).count() == 3 and len(calls) == 1
    source.cached_or_built(spark, path, build, rebuild=True)
    assert len(calls) == 2


def test_key_sample_keeps_whole_cards(events):
    got = source.sample_keys(events, 3)
    cards = [r[0] for r in got.select("card_id").distinct().collect()]
    assert len(cards) == 3 and got.count() == events.filter(F.col("card_id").isin(cards)).count()


def test_streamed_features_equal_batch_features(spark, events, tmp_path):
    base = str(tmp_path)
    jobs.produce(events, f"{base}/wire")
    ran = jobs.features_stream(spark, f"{base}/wire", f"{base}/store", f"{base}/scoring", f"{base}/check")
    assert ran["batches"] > 1 and ran["consumed"] == 200
    scoring = spark.read.parquet(f"{base}/scoring").select("transaction_id", *FEATURE_NAMES)
    assert parity.row_report(windows.trailing_features(events), scoring).first()["passed"] and scoring.count() == 200
    assert ran["scored"] == 200 and ran["malformed"] == ran["released"] == ran["late"] == 0 and ran["pushed"] > 0 and ran["offsets"]
    latest = jobs.LatestStore(spark, f"{base}/store")
    jobs.land_stream(spark, f"{base}/wire", f"{base}/landing", f"{base}/rejects", f"{base}/check2")
    rebuilt = jobs.finalized(spark, latest, f"{base}/landing")
    assert parity.row_report(rebuilt, store.store_view(events), "card_id").first()["passed"]
    assert latest.read().count() <= rebuilt.count()


def test_upsert_drops_rows_that_are_not_newer(spark):
    old = spark.createDataFrame([("a", 5, 1), ("b", 5, 1)], "card_id string, committed_ts long, x int")
    new = spark.createDataFrame([("a", 5, 2), ("b", 6, 2), ("c", 1, 2)], "card_id string, committed_ts long, x int")
    assert {(r["card_id"], r["x"]) for r in store.upsert_newer(old, new).collect()} == {("a", 1), ("b", 2), ("c", 2)}


def _row(card, ts, n=1):
    return (card, ts, *[float(n) if f.dtype == "float64" else n for f in FEATURES])


def _store_rows(spark, *rows):
    schema = "card_id string, committed_ts long, " + ", ".join(f"{f.name} {'double' if f.dtype == 'float64' else 'long'}" for f in FEATURES)
    return spark.createDataFrame([_row(*r) for r in rows], schema)


def test_the_store_keeps_what_other_jobs_wrote(spark, tmp_path):
    """A new checkpoint begins at batch 0 again and must not hide newer versions; a batch that is run again adds nothing."""
    latest = jobs.LatestStore(spark, str(tmp_path / "store"))
    latest.upsert(_store_rows(spark, ("a", 10), ("b", 10)), 0, "one")
    latest.upsert(_store_rows(spark, ("a", 20), ("a", 15)), 1, "one")
    latest.upsert(_store_rows(spark, ("c", 5), ("b", 9)), 0, "two")
    latest.upsert(_store_rows(spark, ("a", 99)), 1, "one")  # the same batch again, with other rows
    got = {r["card_id"]: r["committed_ts"] for r in latest.read().collect()}
    assert got == {"a": 20, "b": 10, "c": 5}
    assert latest.read().filter("card_id = 'a'").first()["txn_count_1h"] == 1
    with pytest.raises(ValueError, match="null"):
        latest.upsert(_store_rows(spark, ("d", 1)).withColumn("amt_sum_1h", F.lit(None).cast("double")), 0, "three")


def test_the_store_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs.LatestStore, "COMPACT", 2)
    latest = jobs.LatestStore(spark, str(tmp_path / "store"))
    for i in range(8):
        latest.upsert(_store_rows(spark, (f"c{i % 3}", i), ("old", 100 - i)), i, "one")
    kinds = [k for _, k, _ in latest.folders()]
    assert "base" in kinds and len(kinds) < 8
    assert {r["card_id"]: r["committed_ts"] for r in latest.read().collect()} == {"c0": 6, "c1": 7, "c2": 5, "old": 100}


def test_kafka_records_are_messages(spark):
    records = spark.createDataFrame([(bytearray(b'{"x": 1}'), 7, 3)], "value binary, offset long, partition int")
    assert [tuple(r) for r in jobs.from_kafka(records).collect()] == [('{"x": 1}', 7)]


def test_malformed_messages_are_counted(spark, events, tmp_path):
    base = str(tmp_path)
    jobs.produce(events, f"{base}/wire")
    spark.createDataFrame([("{broken",), ("{}",)], "value string").coalesce(1).write.mode("append").text(f"{base}/wire")
    ran = jobs.land_stream(spark, f"{base}/wire", f"{base}/landing", f"{base}/rejects", f"{base}/check")
    assert (ran["consumed"], ran["malformed"], ran["written"]) == (202, 2, 200)
    assert spark.read.parquet(f"{base}/rejects").count() == 2
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    jobs.features_stream(spark, f"{base}/wire", f"{base}/store", f"{base}/scoring", f"{base}/check2")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_the_generator_has_its_distributions(spark):
    made = synthetic(spark, n_cards=50, n_events=8000, seed=3)
    gaps = dataset.median_gap(made.filter("card_id = 'card_00001'")).first()[0]
    assert 9_000 < gaps < 14_500  # the median of exponential gaps of mean 18,000 s, less what ties take
    rate = {r["b"]: r["r"] for r in made.groupBy((F.col("amount") > 237).alias("b")).agg(F.avg("is_fraud").alias("r")).collect()}
    assert rate[True] > 2 * rate[False]
    shares = {r["card_network"]: r["count"] / 8000 for r in made.groupBy("card_network").count().collect()}
    assert all(0.3 < s < 0.37 for s in shares.values())
    shifted = synthetic(spark, n_cards=50, n_events=8000, seed=3, shift="amount")
    assert shifted.agg(F.avg("is_fraud")).first()[0] == made.agg(F.avg("is_fraud")).first()[0]

"""The store view: what a card's state holds after its events, and checks of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.features import is_close
from millrace.operators.asof import unambiguous_last
from millrace.operators.windows import _features, seconds, trailing_features
from millrace.sources.events import known_product
from millrace.spec import FEATURE_NAMES, FEATURES, PRODUCTS, WINDOWS


def store_view(events: DataFrame, entity: str = "card_id", ts: str = "event_timestamp") -> DataFrame:
    """(card, committed_ts, 19 features) with every event folded in; windows end at the card's own last event."""
    rows = events.select(F.col(entity), seconds(ts).alias("_u"), F.col("amount").cast("double").alias("_amount"), known_product(F.col("product_cd")).alias("_code"))
    last = rows.groupBy(entity).agg(F.max("_u").alias("_last"))
    rows = rows.join(last, entity)

    def inside(w: str):
        return F.col("_u") > F.col("_last") - WINDOWS[w]

    sums = {f"n_{w}": F.count(F.when(inside(w), 1)) for w in WINDOWS} | {f"s_{w}": F.sum(F.when(inside(w), F.col("_amount"))) for w in WINDOWS}
    sums |= {f"m_{w}": F.max(F.when(inside(w), F.col("_amount"))) for w in WINDOWS}
    sums |= {f"p_{p}": F.count(F.when(inside("7d") & (F.col("_code") == p), 1)) for p in PRODUCTS}
    held = rows.groupBy(entity, "_last").agg(F.count(F.lit(1)).alias("born"), *[c.alias(n) for n, c in sums.items()])
    made = _features(
        {w: F.col(f"n_{w}") for w in WINDOWS}, {w: F.col(f"s_{w}") for w in WINDOWS}, {w: F.col(f"m_{w}") for w in WINDOWS},
        F.col("_last"), F.col("born"), {p: F.col(f"p_{p}") for p in PRODUCTS},
    )
    return held.select(entity, F.col("_last").alias("committed_ts"), *made)


def fold_last_event(last: DataFrame, entity: str = "card_id", ts: str = "event_timestamp") -> DataFrame:
    """What the store holds after a row's own event, for lifetime, last time and the counters that only grow by it.

    Windows end at the event itself, so nothing that the row saw is evicted by it."""
    u, code = seconds(ts), known_product(F.col("product_cd"))
    grown = {"last_txn_unixtime": u.cast("double"), "txn_count_lifetime": F.col("txn_count_lifetime") + 1}
    for w in WINDOWS:
        n, s = F.col(f"txn_count_{w}") + 1, F.col(f"amt_sum_{w}") + F.col("amount")
        top = F.when(F.col(f"txn_count_{w}") > 0, F.greatest(f"amt_max_{w}", "amount")).otherwise(F.col("amount"))
        grown |= {f"txn_count_{w}": n, f"amt_sum_{w}": s, f"amt_mean_{w}": s / n, f"amt_max_{w}": top}
    grown |= {f"product_{p}_count_7d": F.col(f"product_{p}_count_7d") + (code == p).cast("long") for p in PRODUCTS}
    return last.select(entity, u.alias("committed_ts"), *[grown[f.name].cast(f.spark_type).alias(f.name) for f in FEATURES])


def recent(events: DataFrame, days: int, ts: str = "event_timestamp") -> DataFrame:
    """Events of the last days of the whole stream."""
    newest = events.agg(F.max(seconds(ts)).alias("_newest"))
    return events.join(F.broadcast(newest), seconds(ts) > F.col("_newest") - days * 86400).drop("_newest")  # the right side is one row


def replay_damage(full: DataFrame, bounded: DataFrame, entity: str = "card_id") -> DataFrame:
    """Per feature: cards that a bounded replay gets wrong, of those it has, with largest and mean absolute error."""
    names = FEATURE_NAMES
    pairs = full.alias("f").join(bounded.alias("b"), entity)
    long = pairs.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"f.{n}").cast("double").alias("full"), F.col(f"b.{n}").cast("double").alias("bounded")) for n in names])).alias("x")).select("x.*")
    # sums of the same amounts may differ in their last digits
    wrong, gap = ~is_close(F.col("bounded"), F.col("full")), F.abs(F.col("full") - F.col("bounded"))
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_cards"),
        F.count(F.when(wrong, 1)).alias("n_wrong"),
        F.avg(wrong.cast("double")).alias("wrong_rate"),
        F.max(gap).alias("max_error"),
        F.avg(gap).alias("mean_abs_error"),
    )


def key_counts(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("n_keys"))


def snapshot_at(events: DataFrame, asked: DataFrame, at: str = "at", entity: str = "card_id", ts: str = "event_timestamp") -> DataFrame:
    """asked (card, at in seconds) with the features as they stood at that time, its own second included.

    Unlike the store's rows, windows end at the time asked for and decay without new events.  A card
    without earlier events has the defaults."""
    facts = events.select(F.col(entity).alias("_card"), seconds(ts).alias("_u"), F.col("amount").cast("double").alias("_amount"), known_product(F.col("product_cd")).alias("_code"))
    keys = asked.select(F.col(entity), F.col(at).cast("long").alias(at)).distinct()
    rows = keys.join(facts, (F.col(entity) == F.col("_card")) & (F.col("_u") <= F.col(at)), "left")

    def inside(w: str):
        return F.col("_u") > F.col(at) - WINDOWS[w]

    sums = {f"n_{w}": F.count(F.when(inside(w), 1)) for w in WINDOWS} | {f"s_{w}": F.sum(F.when(inside(w), F.col("_amount"))) for w in WINDOWS}
    sums |= {f"m_{w}": F.max(F.when(inside(w), F.col("_amount"))) for w in WINDOWS}
    sums |= {f"p_{p}": F.count(F.when(inside("7d") & (F.col("_code") == p), 1)) for p in PRODUCTS}
    held = rows.groupBy(entity, at).agg(F.max("_u").alias("_last"), F.count("_u").alias("_born"), *[c.alias(n) for n, c in sums.items()])
    made = _features(
        {w: F.col(f"n_{w}") for w in WINDOWS}, {w: F.col(f"s_{w}") for w in WINDOWS}, {w: F.col(f"m_{w}") for w in WINDOWS},
        F.col("_last"), F.col("_born"), {p: F.col(f"p_{p}") for p in PRODUCTS},
    )
    return held.select(entity, at, *made)


def spot_check(events: DataFrame, stored: DataFrame, n: int = 20, seed: int = 7, entity: str = "card_id", ts: str = "event_timestamp") -> DataFrame:
    """(card, n_differ) of n cards chosen by a seeded hash: the last offline row with its own event folded in against the stored row.

    Cards whose last time is tied are not asked, and a card that is not stored differs in every feature."""
    last = unambiguous_last(events.select(entity, ts), entity, ts).select(entity)
    chosen = last.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(entity))), entity).limit(n)
    own = events.join(F.broadcast(chosen), entity, "left_semi")  # n ids at most
    folded = fold_last_event(unambiguous_last(trailing_features(own), entity, ts), entity, ts)
    both = folded.alias("a").join(stored.select(entity, *FEATURE_NAMES).alias("b"), entity, "left")
    differ = [(~F.coalesce(is_close(F.col(f"b.{n}").cast("double"), F.col(f"a.{n}").cast("double")), F.lit(False))).cast("long") for n in FEATURE_NAMES]
    return both.select(entity, sum(differ[1:], differ[0]).alias("n_differ"))


def upsert_newer(stored: DataFrame, incoming: DataFrame, entity: str = "card_id", ts: str = "committed_ts") -> DataFrame:
    """Latest row of each key; an incoming row that is not newer than the stored one is dropped."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest_versions(both, "_new", entity, ts)


def latest_versions(rows: DataFrame, version: str, entity: str = "card_id", ts: str = "committed_ts") -> DataFrame:
    """Of each key the row of the greatest time, of equal times the one of the least version; a pre-aggregated maximum."""
    rest = [c for c in rows.columns if c not in (entity, version)]
    best = rows.groupBy(entity).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), -F.col(version))).alias("_row"))
    return best.select(entity, "_row.*").select(*[c for c in rows.columns if c != version])

"""Trailing-window features, in three forms that give the same values.

`trailing_features` states each feature over one window per card; all frames share one exchange
and sort.  `trailing_features_balanced` is for cards with very many events: Spark evaluates a
sliding range frame again for each row, so it is rewritten to running aggregates in blocks of the
window's length.  `trailing_features_by_size` chooses by card.  `arrival_features` is the
policy under which an event sees earlier ties.

Amounts are added as they are.  No form subtracts, so a large amount that has left a window leaves
no trace; forms that add in different orders agree to a double's precision.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.events import known_product
from millrace.spec import FEATURE_NAMES, FEATURES, NO_LAST, PRODUCTS, WINDOWS
from millrace.storage import checkpoint


def require(df: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")


def seconds(ts: str | Column) -> Column:
    """Whole unix seconds; sub-second parts are dropped."""
    return F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def _features(count: dict[str, Column], total: dict[str, Column], top: dict[str, Column], last: Column, lifetime: Column, product: dict[str, Column]) -> list[Column]:
    """The 19 columns in the order of the spec, defaults filled in."""
    made: dict[str, Column] = {"last_txn_unixtime": F.coalesce(last.cast("double"), F.lit(NO_LAST)), "txn_count_lifetime": F.coalesce(lifetime, F.lit(0))}
    for w in WINDOWS:
        n, s = F.coalesce(count[w], F.lit(0)), F.coalesce(total[w], F.lit(0.0))
        made |= {f"txn_count_{w}": n, f"amt_sum_{w}": s, f"amt_mean_{w}": F.when(n > 0, s / n).otherwise(0.0), f"amt_max_{w}": F.coalesce(top[w], F.lit(0.0))}
    made |= {f"product_{p}_count_7d": F.coalesce(product[p], F.lit(0)) for p in PRODUCTS}
    return [made[f.name].cast(f.spark_type).alias(f.name) for f in FEATURES]


def trailing_features(events: DataFrame, entity: str = "card_id", ts: str = "event_timestamp", amount: str = "amount", product: str = "product_cd") -> DataFrame:
    """events with the 19 features of the spec."""
    require(events, entity, ts, amount, product)
    rows = events.withColumns({"_u": seconds(ts), "_amount": F.col(amount).cast("double"), "_code": known_product(F.col(product))})
    order = Window.partitionBy(entity).orderBy("_u")
    frame = {w: order.rangeBetween(-(n - 1), -1) for w, n in WINDOWS.items()}
    past = order.rangeBetween(Window.unboundedPreceding, -1)
    made = _features(
        {w: F.count(F.lit(1)).over(frame[w]) for w in WINDOWS},
        {w: F.sum("_amount").over(frame[w]) for w in WINDOWS},
        {w: F.max("_amount").over(frame[w]) for w in WINDOWS},
        F.max("_u").over(past),
        F.count(F.lit(1)).over(past),
        {p: F.count(F.when(F.col("_code") == p, 1)).over(frame["7d"]) for p in PRODUCTS},
    )
    return rows.select(*events.columns, *made)


def trailing_features_balanced(events: DataFrame, entity: str = "card_id", ts: str = "event_timestamp", amount: str = "amount", product: str = "product_cd", key: str = "transaction_id") -> DataFrame:
    """The same columns in time n log n for any number of events of a card, and with a card dealt over many tasks.

    Time is cut into blocks as long as the window.  (t - W, t) is then what lies after t - W in the
    block before t's and what lies before t in t's own, so two running aggregates by card and block
    give it.  What lies in all earlier blocks comes from one row per card and block."""
    require(events, entity, ts, amount, product, key)
    base = events.select(
        F.col(key).alias("_id"), F.col(entity).alias("_card"), seconds(ts).alias("_u"), F.col(amount).cast("double").alias("_amount"), known_product(F.col(product)).alias("_code")
    )
    parts = reduce(DataFrame.unionByName, [_by_block(base, w) for w in WINDOWS])
    sums = [F.sum(F.when(F.col("w") == w, F.col(c))).alias(f"{c}_{w}") for w in WINDOWS for c in ("n", "s")]
    tops = [F.max(F.when(F.col("w") == w, F.col("top"))).alias(f"top_{w}") for w in WINDOWS]
    longest = F.col("w") == "7d"
    inside = [F.sum(F.when(longest, F.col(f"p_{p}"))).alias(f"p_{p}") for p in PRODUCTS]
    own = [F.sum(F.when(longest & (F.col("kind") == 1), F.col("n"))).alias("own_n"), F.max(F.when(longest & (F.col("kind") == 1), F.col("seen"))).alias("own_seen")]
    found = parts.groupBy("_id").agg(*sums, *tops, *inside, *own)
    block = F.floor(F.col("_u") / WINDOWS["7d"]).alias("block")
    past = Window.partitionBy("_card").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy("_card", block).agg(F.count(F.lit(1)).alias("n"), F.max("_u").alias("seen"))
    earlier = totals.select("_card", "block", F.sum("n").over(past).alias("past_n"), F.max("seen").over(past).alias("past_seen"))
    # events without a card are one card, as in the window form
    now = base.select("_id", F.col("_card").alias("_c"), block.alias("_b"))
    joined = now.join(earlier, F.col("_c").eqNullSafe(F.col("_card")) & (F.col("_b") == F.col("block"))).join(found, "_id")
    made = _features(
        {w: F.col(f"n_{w}") for w in WINDOWS},
        {w: F.col(f"s_{w}") for w in WINDOWS},
        {w: F.col(f"top_{w}") for w in WINDOWS},
        F.coalesce("own_seen", "past_seen"),
        F.coalesce("own_n", F.lit(0)) + F.coalesce("past_n", F.lit(0)),
        {p: F.col(f"p_{p}") for p in PRODUCTS},
    )
    return events.join(joined.select(F.col("_id").alias(key), *made), key).select(*events.columns, *FEATURE_NAMES)


def _by_block(base: DataFrame, w: str) -> DataFrame:
    """(_id, w, kind, aggregates): kind 1 over what is before t in its block, kind 2 over what is after t - W in the block before."""
    length, u = WINDOWS[w], F.col("_u")
    block = F.floor(u / length)
    rows = F.array(*[F.struct((block - int(kind == 2)).alias("block"), (u - (length if kind == 2 else 0)).alias("at"), F.lit(kind).alias("kind")) for kind in (0, 1, 2)])
    line = base.select("_id", "_card", "_amount", "_code", F.explode(rows).alias("m")).select("*", "m.*").drop("m")
    born = F.col("kind") == 0
    values = {"n": (F.count, F.when(born, 1)), "s": (F.sum, F.when(born, F.col("_amount"))), "top": (F.max, F.when(born, F.col("_amount"))), "seen": (F.max, F.when(born, F.col("at")))}
    values |= {f"p_{p}": (F.count, F.when(born & (F.col("_code") == p), 1)) for p in PRODUCTS}
    group = Window.partitionBy("_card", "block")
    before = group.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    after = group.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    found = [F.when(F.col("kind") == 1, f(x).over(before)).otherwise(f(x).over(after)).alias(c) for c, (f, x) in values.items()]
    return line.select("_id", F.lit(w).alias("w"), "kind", *found).filter("kind > 0")


#: events of a card from which it takes the balanced form
HOT_EVENTS = 100_000
#: cards in that form up to which their names are broadcast
BROADCAST_CARDS = 100_000


def trailing_features_by_size(
    events: DataFrame, entity: str = "card_id", ts: str = "event_timestamp", amount: str = "amount", product: str = "product_cd", key: str = "transaction_id", hot_events: int = HOT_EVENTS
) -> DataFrame:
    """The same columns, each card in the form that its number of events asks for.

    Counts are made before anything moves.  Cards over `hot_events` take the balanced form and the
    others the window form, in which no task then has more than that of one card."""
    require(events, entity, ts, amount, product, key)
    sizes = events.groupBy(F.col(entity).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    hot = checkpoint(sizes.filter(F.col("_n") > hot_events).select("_hot"))
    n = hot.count()
    if not n:
        return trailing_features(events, entity, ts, amount, product)
    # beyond that bound the join is shuffled, and the session's skew join splits a hot card's side
    names = F.broadcast(hot) if n <= BROADCAST_CARDS else hot
    same = F.col(entity).eqNullSafe(F.col("_hot"))
    rest = trailing_features(events.join(names, same, "left_anti"), entity, ts, amount, product)
    return rest.unionByName(trailing_features_balanced(events.join(names, same, "left_semi"), entity, ts, amount, product, key))


def range_join_features(events: DataFrame, entity: str = "card_id", ts: str = "event_timestamp", amount: str = "amount", product: str = "product_cd", key: str = "transaction_id") -> DataFrame:
    """The same columns by a self-join over time, grouped by the later event: for checks on small tables, as it pairs all events of a card."""
    now = events.select(F.col(key), F.col(entity).alias("_card"), seconds(ts).alias("_u"))
    old = events.select(F.col(entity).alias("_card"), seconds(ts).alias("_v"), F.col(amount).cast("double").alias("_amount"), known_product(F.col(product)).alias("_code"))
    pairs = now.join(old, now["_card"].eqNullSafe(old["_card"]) & (F.col("_v") < F.col("_u")), "left")

    def inside(w: str) -> Column:
        return F.col("_v") > F.col("_u") - WINDOWS[w]

    sums = {f"n_{w}": F.count(F.when(inside(w), 1)) for w in WINDOWS} | {f"s_{w}": F.sum(F.when(inside(w), F.col("_amount"))) for w in WINDOWS}
    sums |= {f"m_{w}": F.max(F.when(inside(w), F.col("_amount"))) for w in WINDOWS}
    sums |= {f"p_{p}": F.count(F.when(inside("7d") & (F.col("_code") == p), 1)) for p in PRODUCTS}
    held = pairs.groupBy(key).agg(F.max("_v").alias("_last"), F.count("_v").alias("_born"), *[c.alias(n) for n, c in sums.items()])
    made = _features(
        {w: F.col(f"n_{w}") for w in WINDOWS}, {w: F.col(f"s_{w}") for w in WINDOWS}, {w: F.col(f"m_{w}") for w in WINDOWS},
        F.col("_last"), F.col("_born"), {p: F.col(f"p_{p}") for p in PRODUCTS},
    )
    return events.join(held.select(key, *made), key).select(*events.columns, *FEATURE_NAMES)


def arrival_features(events: DataFrame, entity: str = "card_id", ts: str = "event_timestamp", key: str = "transaction_id", form: Callable[..., DataFrame] = trailing_features) -> DataFrame:
    """Features that also see tied events of a smaller id (the policy without a watermark).

    `form` makes the features of what lies before; ties add one window by card and second."""
    rows = form(events, entity, ts).withColumns({"_u": seconds(ts), "_amount": F.col("amount").cast("double"), "_code": known_product(F.col("product_cd"))})
    tied = Window.partitionBy(entity, "_u").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(tied), "_s": F.coalesce(F.sum("_amount").over(tied), F.lit(0.0)), "_top": F.max("_amount").over(tied)} | {f"_p{p}": F.count(F.when(F.col("_code") == p, 1)).over(tied) for p in PRODUCTS})
    total = {w: F.col(f"amt_sum_{w}") + F.col("_s") for w in WINDOWS}
    top = {w: F.greatest(F.when(F.col(f"txn_count_{w}") > 0, F.col(f"amt_max_{w}")), F.col("_top")) for w in WINDOWS}
    made = _features(
        {w: F.col(f"txn_count_{w}") + F.col("_n") for w in WINDOWS},
        total,
        top,
        F.when(F.col("_n") > 0, F.col("_u").cast("double")).otherwise(F.col("last_txn_unixtime")),
        F.col("txn_count_lifetime") + F.col("_n"),
        {p: F.col(f"product_{p}_count_7d") + F.col(f"_p{p}") for p in PRODUCTS},
    )
    return rows.select(*events.columns, *made)


def tie_rank(events: DataFrame, entity: str = "card_id", ts: str = "event_timestamp", key: str = "transaction_id") -> DataFrame:
    """events with the rank among ties (from 0) and a timestamp that it makes unique by microseconds."""
    u = seconds(ts)
    rank = F.row_number().over(Window.partitionBy(entity, u).orderBy(key)) - 1
    ranked = events.withColumn("tie_rank", rank.cast("long"))
    safe = F.when(F.col("tie_rank") >= 1_000_000, F.raise_error(F.lit("more ties than microseconds in a second"))).otherwise(F.col("tie_rank"))
    return ranked.withColumn("unique_timestamp", F.timestamp_micros(seconds(ts) * 1_000_000 + safe.cast("long")))

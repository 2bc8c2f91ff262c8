"""Distribution drift: injected shifts, statistics per column, and one decision.

A column's score is the Wasserstein distance of the two samples over the reference's population
standard deviation (drift above DRIFTED); the Kolmogorov-Smirnov distance and the population
stability index are given beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.features import finite, ondemand
from millrace.operators.ordered import running_sums
from millrace.operators.windows import seconds, trailing_features
from millrace.spec import KEY_FEATURES, MONITORED
from millrace.storage import checkpoint

DRIFTED = 0.1
SHARE = 0.3
AMOUNT_FACTOR = 4.0
GAP_DIVISOR = 20
BINS = 10
KINDS = ("none", "amount", "velocity", "product")


def inject_shift(events: DataFrame, kind: str, ts: str = "event_timestamp", key: str = "transaction_id") -> DataFrame:
    """Events with larger amounts, compressed gaps of each card (from its first event on), or one product only."""
    if kind not in KINDS:
        raise ValueError(f"unknown shift {kind!r}")
    if kind == "amount":
        return events.withColumn("amount", F.col("amount") * AMOUNT_FACTOR)
    if kind == "product":
        return events.withColumn("product_cd", F.lit("C"))
    if kind == "velocity":
        order = Window.partitionBy("card_id").orderBy(ts, key)
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        gapped = events.withColumn("_gap", F.coalesce(F.floor((micros - F.lag(micros).over(order)) / GAP_DIVISOR), F.lit(0)).cast("long"))
        moved = F.min(micros).over(Window.partitionBy("card_id")) + F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))
        return gapped.withColumn(ts, F.timestamp_micros(moved)).drop("_gap")
    return events


def feature_tail(events: DataFrame, kind: str = "none", tail_share: float = 0.15) -> DataFrame:
    """Features over the whole shifted stream, then the last share of it in time order."""
    from millrace.operators.dataset import position

    shifted = inject_shift(events, kind)
    full = trailing_features(shifted).withColumns(ondemand())
    n = shifted.count()
    cut = position(shifted, n - int(n * tail_share))
    if cut is None:
        return full.limit(0)
    u = seconds("event_timestamp")
    return full.filter((u > cut[0]) | ((u == cut[0]) & (F.col("transaction_id") >= cut[1])))


def halves(df: DataFrame, key: str = "transaction_id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two disjoint halves by a seeded hash."""
    coin = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % 2
    return df.filter(coin == 0), df.filter(coin == 1)


def _long(df: DataFrame, columns: list[str], side: int) -> DataFrame:
    # sums of the same amounts may differ in their last digits: values that agree to nine digits are one
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.round(finite(F.col(c)), 9).alias("x")) for c in columns])
    return df.select(F.explode(rows).alias("r")).groupBy("r.column", "r.x").agg(F.count(F.lit(1)).alias("n")).select("column", "x", F.lit(side).alias("side"), "n")


def drift_scores(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, score, ks, drifted): from counts by value, running sums over values give both distribution functions."""
    columns = columns or [c for c in MONITORED if c in reference.columns and c in current.columns]
    both = _long(reference, columns, 0).unionByName(_long(current, columns, 1))
    points = checkpoint(both.groupBy("column", "x").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("c")))
    run = running_sums(points, "x", {"rs": "r", "cs": "c"}, within="column", following="after")
    moments = points.groupBy("column").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.sum(F.col("x") * F.col("r")).alias("sx"), F.sum(F.col("x") * F.col("x") * F.col("r")).alias("sxx"))
    step = F.col("after") - F.col("x")
    # one row of moments for each monitored column
    gaps = run.withColumn("dx", F.coalesce(step, F.lit(0.0))).join(F.broadcast(moments), "column")
    apart = F.abs(F.col("rs") / F.col("nr") - F.col("cs") / F.col("nc"))
    measured = gaps.groupBy("column").agg(F.sum(apart * F.col("dx")).alias("distance"), F.max(apart).alias("ks"), F.first("nr").alias("nr"), F.first("sx").alias("sx"), F.first("sxx").alias("sxx"))
    spread = F.sqrt(F.greatest(F.col("sxx") / F.col("nr") - F.pow(F.col("sx") / F.col("nr"), 2), F.lit(0.0)))
    score = F.when(spread > 0, F.col("distance") / spread).when(F.col("distance") > 0, 1.0).otherwise(0.0)
    return measured.select("column", score.alias("score"), "ks", (score > DRIFTED).alias("drifted"))


def stability_index(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """(column, psi) over equal-width bins of the reference's range; empty bins count as a ten-thousandth."""
    both = _long(reference, columns, 0).unionByName(_long(current, columns, 1))
    range_ = both.filter("side = 0").groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))).otherwise(0)
    counts = both.join(F.broadcast(range_), "column").groupBy("column", place.alias("bin")).agg(F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("r"), F.sum(F.when(F.col("side") == 1, F.col("n"))).alias("c"))
    whole = Window.partitionBy("column")
    p, q = (F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.sum(c).over(whole), F.lit(1e-4)) for c in ("r", "c"))
    terms = counts.withColumn("term", (q - p) * F.log(q / p))
    return terms.groupBy("column").agg(F.sum("term").alias("psi"))


def drift_decision(scores: DataFrame, threshold: float = SHARE) -> DataFrame:
    """Alert if the share of drifted columns reaches the threshold or any key feature drifted; critical from twice the threshold."""
    one = scores.agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count(F.when(F.col("drifted"), 1)).alias("n_drifted"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("drifted") & F.col("column").isin(*KEY_FEATURES), F.col("column"))))).alias("key_drifted"),
    )
    share = F.col("n_drifted") / F.greatest(F.col("n_columns"), F.lit(1))
    alerted = (share >= threshold) | (F.col("key_drifted") != "")
    return one.select("*", share.alias("drift_share"), alerted.alias("alerted"), F.when(~alerted, "quiet").when(share >= 2 * threshold, "critical").otherwise("warning").alias("severity"))


def verdict(found: DataFrame) -> DataFrame:
    """(column, method, value, threshold) with `drifted`, by the direction of the method; without any finding, an error.

    A method that gives a p-value finds drift below its threshold, any other (a distance) above it.
    A null value is no finding: `drifted` is null and the column does not count."""
    tests = F.lower(F.regexp_replace("method", "[^A-Za-z]", "")).contains("pvalue")
    judged = found.withColumn("drifted", F.when(tests, F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold")))
    if judged.filter("drifted is not null").isEmpty():
        raise ValueError("no column has a drift value")
    return judged


def served_window(served: DataFrame, events: DataFrame, window: int = 5000, key: str = "transaction_id") -> DataFrame:
    """The last `window` served rows in time order with the request side of their events, and the request-time features of both.

    A served row without its event keeps its features; what the event would have told is null."""
    latest = served.orderBy(F.desc("u"), F.desc(key)).limit(window)
    request = events.select(key, F.col("amount").cast("double").alias("amount"), "product_cd")
    return latest.join(request, key, "left").withColumns(ondemand(F.col("u")))


def served_drift(served: DataFrame, events: DataFrame, reference: DataFrame, window: int = 5000, columns: list[str] | None = None) -> DataFrame:
    """Drift of what was served lately against a reference of the training set's columns."""
    return drift_scores(reference, served_window(served, events, window), columns)


def worst_columns(scores: DataFrame, n: int = 6) -> DataFrame:
    return scores.filter("drifted").orderBy(F.desc(F.abs("score")), "column").limit(n)


#: what grows with time by itself, so that any later period differs in it
CUMULATIVE = ("txn_count_lifetime",)


def drift_experiment(events: DataFrame, tail_share: float = 0.15, warm_up: int = 0, columns: list[str] | None = None) -> DataFrame:
    """One decision per scenario: random halves must be quiet, each injection must alert and pass the later period's own share.

    The reference leaves out the first `warm_up` seconds, in which windows are not yet full; `columns`
    are those compared (all monitored ones by default).  Each scenario's features are made once."""
    columns = columns or MONITORED
    needed = ["transaction_id", "event_timestamp", *columns]
    base = checkpoint(feature_tail(events, "none", 1.0).select(*needed))
    later = checkpoint(feature_tail(events, "none", tail_share).select(*needed))
    begin = events.agg(F.min(seconds("event_timestamp")).alias("_begin"))
    warm = base.crossJoin(F.broadcast(begin)).filter(seconds("event_timestamp") >= F.col("_begin") + warm_up).drop("_begin")  # one row
    earlier = checkpoint(warm.join(later.select("transaction_id"), "transaction_id", "left_anti"))
    one, two = halves(earlier)
    pairs = {"null": (one, two), "temporal": (earlier, later)} | {k: (earlier, feature_tail(events, k, tail_share)) for k in KINDS[1:]}
    found = None
    for name, (reference, current) in pairs.items():
        scores = checkpoint(drift_scores(reference, current, columns))
        row = drift_decision(scores).withColumn("scenario", F.lit(name))
        found = row if found is None else found.unionByName(row)
    return found


def experiment_passes(decisions: DataFrame) -> DataFrame:
    """One row: the null is quiet, all injections alert, and all drift more than the later period by itself."""
    floor = F.max(F.when(F.col("scenario") == "temporal", F.col("drift_share")))
    injected = F.col("scenario").isin(*KINDS[1:])
    return decisions.agg(
        F.max(F.when(F.col("scenario") == "null", F.col("alerted"))).alias("null_alerted"),
        F.min(F.when(injected, F.col("alerted"))).alias("all_alerted"),
        (F.min(F.when(injected, F.col("drift_share"))) > floor).alias("all_exceed"),
    ).withColumn("passed", ~F.col("null_alerted") & F.col("all_alerted") & F.col("all_exceed"))

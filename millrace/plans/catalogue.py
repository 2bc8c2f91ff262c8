"""Queries by name over the driver's tables, and the SQL that gives the same rows.

The driver's `events` are read through an adapter to the canonical schema.  Ties are rare at
second grain, so tie-sensitive queries run on the coarse view, whose times are whole hours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import features as fx
from millrace.operators import asof, dataset, drift, gates, metrics, model, parity, serving, store, windows
from millrace.sources import events as source
from millrace.spec import CATEGORICAL, DEFAULTS, FEATURE_NAMES, FEATURES, KEY_FEATURES, MODEL_INPUTS, MONITORED, ONDEMAND, PRODUCTS, WINDOWS
from millrace.storage import checkpoint, drop, scratch
from millrace.streaming import jobs, state

# Event types of the driver's table and the products they stand for.
PRODUCT_OF = {"view": "W", "click": "C", "error": "R", "signup": "H", "purchase": "S"}
LABEL_FROM = 97
COARSE = "hour"


def events(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    code = F.coalesce(*[F.when(F.col("event_type") == t, p) for t, p in PRODUCT_OF.items()], F.lit("W"))
    return raw.select(
        F.col("event_id").cast("long").alias("transaction_id"),
        F.concat(F.lit("card_"), F.col("user_id").cast("string")).alias("card_id"),
        (F.date_trunc(COARSE, ts) if coarse else ts).alias("event_timestamp"),
        F.col("value").cast("double").alias("amount"),
        code.alias("product_cd"),
        F.when(F.col("user_id") % 3 == 0, "visa").when(F.col("user_id") % 3 == 1, "mastercard").otherwise("discover").alias("card_network"),
        F.when(F.col("user_id") % 2 == 0, "credit").otherwise("debit").alias("card_type"),
        F.lit("example.com").alias("email_domain"),
        F.when(k % 10 != 0, k.cast("double")).alias("addr1"),
        F.col("value").cast("double").alias("dist1"),
        (k >= LABEL_FROM).cast("int").alias("is_fraud"),
    )


def _cases(column: str, of: dict[str, str], other: str) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{a}' THEN '{b}'" for a, b in of.items())} ELSE '{other}' END"


def _ev(coarse: bool = False, name: str = "ev") -> str:
    """A common table expression of the canonical events with u in seconds."""
    ts = f"date_trunc('{COARSE}', ts)" if coarse else "ts"
    return f"""{name} AS (
  SELECT event_id AS transaction_id, 'card_' || CAST(user_id AS VARCHAR) AS card_id, epoch_us({ts}) AS us, epoch_us({ts}) // 1000000 AS u,
    value AS amount, {_cases("event_type", PRODUCT_OF, "W")} AS product_cd,
    CASE user_id % 3 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' ELSE 'discover' END AS card_network,
    CASE user_id % 2 WHEN 0 THEN 'credit' ELSE 'debit' END AS card_type, 'example.com' AS email_domain,
    CASE WHEN k % 10 <> 0 THEN CAST(k AS DOUBLE) END AS addr1, value AS dist1, CASE WHEN k >= {LABEL_FROM} THEN 1 ELSE 0 END AS is_fraud
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events))"""


def _pick(count: Callable[[str], str], total: Callable[[str], str], top: Callable[[str], str], last: str, born: str, product: Callable[[str], str]) -> str:
    """The 19 features as SQL columns from expressions by window."""
    made = {"last_txn_unixtime": f"coalesce(CAST({last} AS DOUBLE), -1)", "txn_count_lifetime": f"CAST(coalesce({born}, 0) AS BIGINT)"}
    for w in WINDOWS:
        n, s = f"CAST(coalesce({count(w)}, 0) AS BIGINT)", f"coalesce({total(w)}, 0.0)"
        made |= {f"txn_count_{w}": n, f"amt_sum_{w}": s, f"amt_mean_{w}": f"CASE WHEN {n} > 0 THEN ({s}) / {n} ELSE 0.0 END", f"amt_max_{w}": f"coalesce({top(w)}, 0.0)"}
    made |= {f"product_{p}_count_7d": f"CAST(coalesce({product(p)}, 0) AS BIGINT)" for p in PRODUCTS}
    cast = {"int64": "BIGINT", "float64": "DOUBLE"}
    return ", ".join(f"CAST({made[f.name]} AS {cast[f.dtype]}) AS {f.name}" for f in FEATURES)


def _framed(source_name: str = "ev", name: str = "feat") -> str:
    """Features by range frames."""

    def over(w: str) -> str:
        return f"OVER (PARTITION BY card_id ORDER BY u RANGE BETWEEN {WINDOWS[w] - 1} PRECEDING AND 1 PRECEDING)"

    past = "OVER (PARTITION BY card_id ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    columns = _pick(
        lambda w: f"count(*) {over(w)}", lambda w: f"sum(amount) {over(w)}", lambda w: f"max(amount) {over(w)}",
        f"max(u) {past}", f"count(*) {past}", lambda p: f"sum(CASE WHEN product_cd = '{p}' THEN 1 ELSE 0 END) {over('7d')}",
    )
    return f"{name} AS (SELECT {source_name}.*, {columns} FROM {source_name})"


def _grouped(source_name: str, name: str, inside: Callable[[str], str], by: str, last: str, born: str) -> str:
    columns = _pick(
        lambda w: f"count(CASE WHEN {inside(w)} THEN 1 END)", lambda w: f"sum(CASE WHEN {inside(w)} THEN amount END)", lambda w: f"max(CASE WHEN {inside(w)} THEN amount END)",
        last, born, lambda p: f"count(CASE WHEN {inside('7d')} AND product_cd = '{p}' THEN 1 END)",
    )
    return f"{name} AS (SELECT {by}, {columns} FROM {source_name} GROUP BY {by})"


#: sums of doubles depend on their order: nine digits of them do not
DIGITS = 9


def _settled(names: list[str]) -> str:
    """SQL columns with amounts rounded to what does not depend on the order of addition."""
    return ", ".join(f"round({n}, {DIGITS}) AS {n}" if n.startswith(("amt_", "product_freq")) else n for n in names)


def _select(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, rounded in the same way."""
    return df.select(*[F.round(c, DIGITS).alias(c) if c.startswith(("amt_", "product_freq")) else F.col(c) for c in columns])


ALL = _settled(FEATURE_NAMES)
GROUPS = {
    "window_counts": [f"txn_count_{w}" for w in WINDOWS],
    "window_amounts": [f"amt_{k}_{w}" for k in ("sum", "mean", "max") for w in WINDOWS],
    "window_products": [f"product_{p}_count_7d" for p in PRODUCTS],
    "lifetime_last": ["last_txn_unixtime", "txn_count_lifetime"],
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- canonical events -------------------------------------------------------------------------

_CANONICAL = ["transaction_id", "card_id", "amount", "product_cd", "card_network", "card_type", "email_domain", "addr1", "dist1", "is_fraud"]


def _micros(ts: str = "event_timestamp") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


@query("canonical_events", f"WITH {_ev()} SELECT {', '.join(_CANONICAL)}, us FROM ev")
def canonical_events(spark, sf_dir):
    return events(spark, sf_dir).select(*_CANONICAL, _micros().alias("us"))


@query("canonical_profile", f"WITH {_ev()} SELECT count(*) AS n_rows, count(DISTINCT card_id) AS n_cards, min(us) AS first_us, max(us) AS last_us, CAST(sum(is_fraud) AS DOUBLE) / count(*) AS label_rate FROM ev")
def canonical_profile(spark, sf_dir):
    return source.profile(events(spark, sf_dir)).select("n_rows", "n_cards", _micros("first_ts").alias("first_us"), _micros("last_ts").alias("last_us"), "label_rate")


@query("parquet_roundtrip", f"WITH {_ev()} SELECT {', '.join(_CANONICAL)}, us FROM ev")
def parquet_roundtrip(spark, sf_dir):
    """The event table as a Parquet sink writes it and the source reads it back."""
    path = f"{scratch(spark)}/events"
    source.write_events(events(spark, sf_dir), path)
    return source.load_events(spark, path).select(*_CANONICAL, _micros().alias("us"))


@query("raw_csv_canonical", """
SELECT o_orderkey AS transaction_id, 'card_' || CAST(CASE WHEN o_custkey % 7 = 0 THEN -1 ELSE o_custkey END AS VARCHAR) AS card_id, 1512086400 + o_orderkey AS u, o_totalprice AS amount,
  CASE WHEN o_orderstatus IN ('W', 'C', 'R', 'H', 'S') THEN o_orderstatus ELSE 'W' END AS product_cd, CASE WHEN o_custkey % 5 = 0 THEN 'unknown' ELSE o_orderpriority END AS card_network
FROM orders""")
def raw_csv_canonical(spark, sf_dir):
    """Orders as a raw CSV file with more columns than are read, and nulls, through the CSV reader."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    path = f"{scratch(spark)}/raw"
    key = F.col("o_custkey")
    orders.select(
        F.col("o_orderkey").alias("TransactionID"), F.lit("x").alias("other"), F.col("o_orderkey").alias("TransactionDT"), F.col("o_totalprice").alias("TransactionAmt"), F.col("o_orderstatus").alias("ProductCD"),
        F.when(key % 7 != 0, key).alias("card1"), F.when(key % 5 != 0, F.col("o_orderpriority")).alias("card4"), F.lit("debit").alias("card6"), F.lit(None).cast("string").alias("P_emaildomain"),
        F.lit(None).cast("double").alias("addr1"), F.lit(1.5).alias("dist1"), F.lit(0).alias("isFraud"),
    ).write.csv(path, header=True)
    rows = source.canonical(source.read_raw_csv(spark, path))
    return rows.select("transaction_id", "card_id", windows.seconds("event_timestamp").alias("u"), "amount", "product_cd", "card_network")


# ---- trailing windows -------------------------------------------------------------------------


def _register_windows() -> None:
    for name, columns in GROUPS.items():
        for coarse in (False, True):

            def run(spark, sf_dir, columns=tuple(columns), coarse=coarse):
                return _select(windows.trailing_features(events(spark, sf_dir, coarse)), "transaction_id", *columns)

            query(name + "_coarse" * coarse, f"WITH {_ev(coarse)}, {_framed()} SELECT transaction_id, {_settled(columns)} FROM feat")(run)


_register_windows()
_BRUTE = _grouped("pairs", "brute", lambda w: f"v > u - {WINDOWS[w]}", "id", "max(v)", "count(v)")


@query("features_bruteforce", f"WITH {_ev(True)}, pairs AS (SELECT a.transaction_id AS id, a.u AS u, b.u AS v, b.amount, b.product_cd FROM ev a LEFT JOIN ev b ON a.card_id = b.card_id AND b.u < a.u), {_BRUTE} SELECT id AS transaction_id, {ALL} FROM brute")
def features_bruteforce(spark, sf_dir):
    """A self-join over a range of time, grouped by the later event: quadratic in a card's events, to check the other forms by."""
    return _select(windows.range_join_features(events(spark, sf_dir, True)), "transaction_id", *FEATURE_NAMES)


@query("features_skew_rewrite", f"WITH {_ev(True)}, {_framed()} SELECT transaction_id, {ALL} FROM feat")
def features_skew_rewrite(spark, sf_dir):
    return _select(windows.trailing_features_balanced(events(spark, sf_dir, True)), "transaction_id", *FEATURE_NAMES)


@query("features_by_size", f"WITH {_ev(True)}, {_framed()} SELECT transaction_id, {ALL} FROM feat")
def features_by_size(spark, sf_dir):
    """Cards over the average number of events take the balanced form, the others the window form."""
    rows = events(spark, sf_dir, True)
    n, cards = rows.agg(F.count(F.lit(1)), F.count_distinct("card_id")).first()
    return _select(windows.trailing_features_by_size(rows, hot_events=n // max(cards, 1)), "transaction_id", *FEATURE_NAMES)


@query("tiebreak_rank", f"WITH {_ev(True)} SELECT transaction_id, row_number() OVER (PARTITION BY card_id, u ORDER BY transaction_id) - 1 AS tie_rank, u * 1000000 + row_number() OVER (PARTITION BY card_id, u ORDER BY transaction_id) - 1 AS unique_us FROM ev")
def tiebreak_rank(spark, sf_dir):
    return windows.tie_rank(events(spark, sf_dir, True)).select("transaction_id", "tie_rank", _micros("unique_timestamp").alias("unique_us"))


_SEEN = "(b.u < a.u OR (b.u = a.u AND b.transaction_id < a.transaction_id))"
_ARRIVAL = f"""{_ev(True)}, pairs AS (SELECT a.transaction_id AS id, a.u AS u, b.u AS v, b.amount, b.product_cd FROM ev a LEFT JOIN ev b ON a.card_id = b.card_id AND {_SEEN}),
{_grouped("pairs", "arrival", lambda w: f"v > u - {WINDOWS[w]}", "id", "max(v)", "count(v)")}"""


@query("arrival_features", f"WITH {_ARRIVAL} SELECT id AS transaction_id, {ALL} FROM arrival")
def arrival_features(spark, sf_dir):
    return _select(windows.arrival_features(events(spark, sf_dir, True)), "transaction_id", *FEATURE_NAMES)


_ANY = " OR ".join(f"abs(a.{n} - f.{n}) > 1e-6 + 1e-9 * abs(f.{n})" for n in FEATURE_NAMES)


@query("tie_divergence", f"WITH {_ARRIVAL}, {_framed()} SELECT count(*) AS n_rows, count(CASE WHEN {_ANY} THEN 1 END) AS n_mismatch, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, count(CASE WHEN {_ANY} THEN 1 END) = 0 AS passed FROM arrival a JOIN feat f ON a.id = f.transaction_id")
def tie_divergence(spark, sf_dir):
    """The two policies must differ where times tie."""
    rows = events(spark, sf_dir, True)
    return parity.row_report(windows.trailing_features(rows), windows.arrival_features(rows))


@query("median_gap", f"WITH {_ev()} SELECT CAST(median(gap) AS DOUBLE) AS median_gap FROM (SELECT u - lag(u) OVER (PARTITION BY card_id ORDER BY u, transaction_id) AS gap FROM ev)")
def median_gap(spark, sf_dir):
    return dataset.median_gap(events(spark, sf_dir))


# ---- request-time features and encodings ------------------------------------------------------

_ONDEMAND = """
  CASE WHEN amt_mean_24h > 0 THEN least(amount / (amt_mean_24h + 1e-6), 1000.0) ELSE 0.0 END AS amt_over_mean_24h,
  CASE WHEN amt_max_7d > 0 THEN least(amount / (amt_max_7d + 1e-6), 1000.0) ELSE 0.0 END AS amt_over_max_7d,
  CASE WHEN txn_count_7d > 0 THEN CAST(CASE product_cd """ + " ".join(f"WHEN '{p}' THEN product_{p}_count_7d" for p in PRODUCTS) + """ ELSE 0 END AS DOUBLE) / txn_count_7d ELSE 0.0 END AS product_freq_7d,
  CASE WHEN last_txn_unixtime > -1 THEN CAST(u AS DOUBLE) - last_txn_unixtime ELSE CAST(-1 AS DOUBLE) END AS seconds_since_last_txn"""


@query("ondemand", f"WITH {_ev()}, {_framed()} SELECT transaction_id, {_settled(ONDEMAND)} FROM (SELECT *, {_ONDEMAND} FROM feat)")
def ondemand(spark, sf_dir):
    made = fx.ondemand()
    return _select(windows.trailing_features(events(spark, sf_dir)).withColumns(made), "transaction_id", *made)


@query("calendar", f"WITH {_ev()} SELECT transaction_id, CAST(hour(make_timestamp(us)) AS BIGINT) AS hour_of_day, CAST(isodow(make_timestamp(us)) - 1 AS BIGINT) AS day_of_week FROM ev")
def calendar(spark, sf_dir):
    made = fx.calendar()
    return events(spark, sf_dir).withColumns(made).select("transaction_id", *made)


def _rank_sql(column: str) -> str:
    return f"CAST(coalesce((SELECT count(DISTINCT t.{column}) FROM train t WHERE t.{column} < s.{column}), 0) AS BIGINT)"


_SPLIT = "numbered AS (SELECT *, row_number() OVER (ORDER BY u, transaction_id) - 1 AS place, count(*) OVER () AS n FROM ev), split AS (SELECT *, CASE WHEN place < CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN place < CAST(floor(n * 0.85) AS BIGINT) THEN 'valid' ELSE 'test' END AS split FROM numbered)"


@query("chrono_split", f"WITH {_ev()}, {_SPLIT} SELECT transaction_id, split FROM split")
def chrono_split(spark, sf_dir):
    return dataset.chronological_split(events(spark, sf_dir)).select("transaction_id", "split")


@query("split_profile", f"WITH {_ev()}, {_SPLIT} SELECT split, count(*) AS n_rows, CAST(sum(is_fraud) AS DOUBLE) / count(*) AS label_rate FROM split GROUP BY split")
def split_profile(spark, sf_dir):
    return dataset.split_profile(dataset.chronological_split(events(spark, sf_dir))).select("split", "n_rows", "label_rate")


@query("ordinal_encode", f"WITH {_ev()}, {_SPLIT}, train AS (SELECT * FROM split WHERE split = 'train') SELECT transaction_id, " + ", ".join(f"CASE WHEN {c} IN (SELECT {c} FROM train) THEN {_rank_sql(c)} ELSE -1 END AS {c}" for c in CATEGORICAL) + ", coalesce(addr1, 0.0) AS addr1 FROM split s")
def ordinal_encode(spark, sf_dir):
    rows = dataset.chronological_split(events(spark, sf_dir))
    maps = fx.category_map(rows.filter("split = 'train'"))
    return fx.encode(rows, maps).select("transaction_id", *CATEGORICAL, "addr1")


_DEAD = ["amount", "product_cd", "email_domain", "addr1", "card_type"]


@query("constant_columns", f"WITH {_ev()} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_values, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1 AS is_constant FROM ev" for c in _DEAD))
def constant_columns(spark, sf_dir):
    return dataset.constant_columns(events(spark, sf_dir), _DEAD)


@query("class_weight", f"WITH {_ev()} SELECT count(CASE WHEN is_fraud = 0 THEN 1 END) AS negatives, count(CASE WHEN is_fraud = 1 THEN 1 END) AS positives, CAST(count(CASE WHEN is_fraud = 0 THEN 1 END) AS DOUBLE) / greatest(count(CASE WHEN is_fraud = 1 THEN 1 END), 1) AS weight FROM ev")
def class_weight(spark, sf_dir):
    return dataset.class_weight(events(spark, sf_dir))


# ---- as-of joins, training sets, the store ----------------------------------------------------

_TTL_DAYS = 2


_PURCHASE_VIEW = f"""WITH {_ev(True)}, views AS (SELECT card_id, us, transaction_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY card_id, us ORDER BY transaction_id DESC) AS n FROM ev WHERE product_cd = 'W') WHERE n = 1),
best AS (SELECT p.transaction_id, p.us, max(v.us) AS at FROM ev p LEFT JOIN views v ON p.card_id = v.card_id AND v.us <= p.us WHERE p.product_cd = 'S' GROUP BY p.transaction_id, p.us)
SELECT p.transaction_id, CASE WHEN b.at >= p.us - {_TTL_DAYS * 86400_000_000} THEN v.transaction_id END AS view_id, CASE WHEN b.at >= p.us - {_TTL_DAYS * 86400_000_000} THEN v.amount END AS view_amount
FROM ev p JOIN best b ON p.transaction_id = b.transaction_id LEFT JOIN views v ON v.card_id = p.card_id AND v.us = b.at WHERE p.product_cd = 'S'"""


def _purchase_views(spark, sf_dir, join) -> DataFrame:
    rows = events(spark, sf_dir, True)
    views = rows.filter("product_cd = 'W'").select("card_id", "event_timestamp", F.timestamp_micros("transaction_id").alias("created"), F.col("transaction_id").alias("view_id"), F.col("amount").alias("view_amount"))
    joined = join(rows.filter("product_cd = 'S'"), views, "card_id", "event_timestamp", "event_timestamp", ["view_id", "view_amount"], "created", _TTL_DAYS * 86400)
    return joined.select("transaction_id", "view_id", "view_amount")


@query("asof_purchase_view", _PURCHASE_VIEW)
def asof_purchase_view(spark, sf_dir):
    """Each purchase with the latest view of its card, at most two days old; of tied views the last one."""
    return _purchase_views(spark, sf_dir, asof.asof_join)


@query("asof_purchase_view_balanced", _PURCHASE_VIEW)
def asof_purchase_view_balanced(spark, sf_dir):
    """The same, with a card's time cut into blocks."""
    return _purchase_views(spark, sf_dir, asof.asof_join_balanced)


@query("asof_training_set", f"WITH {_ev(True)}, {_framed()} SELECT transaction_id, {ALL} FROM feat")
def asof_training_set(spark, sf_dir):
    """Features joined as of each event from the stored table, although times tie."""
    rows = events(spark, sf_dir, True)
    return _select(dataset.from_store(rows, dataset.feature_table(rows), None), "transaction_id", *FEATURE_NAMES)


@query("asof_lost_rows", "SELECT CAST(0 AS BIGINT) AS n_lost")
def asof_lost_rows(spark, sf_dir):
    rows = events(spark, sf_dir, True)
    built = dataset.from_store(rows, dataset.feature_table(rows))
    return asof.lost_rows(rows, built, "transaction_id").agg(F.count(F.lit(1)).alias("n_lost"))


_TRAINING = f"WITH {_ev()}, {_framed()} SELECT transaction_id, is_fraud, amount, addr1, dist1, CAST(hour(make_timestamp(us)) AS BIGINT) AS hour_of_day, CAST(isodow(make_timestamp(us)) - 1 AS BIGINT) AS day_of_week, {_settled([n for n in FEATURE_NAMES if n != 'last_txn_unixtime'] + ONDEMAND)}, {', '.join(CATEGORICAL)} FROM (SELECT *, {_ONDEMAND} FROM feat)"


@query("training_set", _TRAINING)
def training_set(spark, sf_dir):
    built = dataset.training_set(events(spark, sf_dir)).drop("card_id", "event_timestamp")
    return _select(built, *built.columns)


@query("training_set_sink", _TRAINING)
def training_set_sink(spark, sf_dir):
    """The training set as its sink writes it: checked for lost events, then read back; a second call does not build it again."""
    path = f"{scratch(spark)}/training"
    dataset.write_training_set(events(spark, sf_dir), path)
    built = dataset.write_training_set(events(spark, sf_dir).limit(0), path).drop("card_id", "event_timestamp")
    return _select(built, *built.columns)


@query("label_csv", f"WITH {_ev()} SELECT is_fraud AS label, round(amount, 9) AS amount, product_cd FROM ev")
def label_csv(spark, sf_dir):
    """Headerless files with the label first, read back by position."""
    path = f"{scratch(spark)}/labels"
    gates.write_label_csv(events(spark, sf_dir), path, ["amount", "product_cd"])
    return spark.read.csv(path, schema="label int, amount double, product_cd string").withColumn("amount", F.round("amount", 9))


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY u DESC, transaction_id DESC) AS n FROM ev) WHERE n = 1"


@query("latest_per_card", f"WITH {_ev(True)} SELECT card_id, transaction_id, u, amount, product_cd FROM ({_LATEST})")
def latest_per_card(spark, sf_dir):
    rows = events(spark, sf_dir, True).withColumn("u", windows.seconds("event_timestamp")).select("card_id", "transaction_id", "u", "amount", "product_cd")
    return asof.latest_per_key(rows, "card_id", "u", "transaction_id")


def _store_sql(source_name: str, name: str) -> str:
    return f"{name}_rows AS (SELECT *, max(u) OVER (PARTITION BY card_id) AS top FROM {source_name}), " + _grouped(f"{name}_rows", name, lambda w: f"u > top - {WINDOWS[w]}", "card_id, top", "top", "count(*)")


@query("store_view", f"WITH {_ev(True)}, {_store_sql('ev', 'st')} SELECT card_id, top AS committed_ts, {ALL} FROM st")
def store_view(spark, sf_dir):
    return _select(store.store_view(events(spark, sf_dir, True)), "card_id", "committed_ts", *FEATURE_NAMES)


@query("fold_last_event", f"WITH {_ev(True)}, {_store_sql('ev', 'st')}, alone AS (SELECT card_id FROM st_rows WHERE u = top GROUP BY card_id HAVING count(*) = 1) SELECT card_id, top AS committed_ts, {ALL} FROM st WHERE card_id IN (SELECT card_id FROM alone)")
def fold_last_event(spark, sf_dir):
    """The last offline row of each card with its own event folded in is what the store holds."""
    rows = windows.trailing_features(events(spark, sf_dir, True))
    return _select(store.fold_last_event(asof.unambiguous_last(rows, "card_id", "event_timestamp")), "card_id", "committed_ts", *FEATURE_NAMES)


@query("online_lookup", f"WITH {_ev()}, {_store_sql('ev', 'st')}, asked AS (SELECT 'card_' || CAST(c_custkey AS VARCHAR) AS card_id FROM customer) SELECT a.card_id, s.card_id IS NOT NULL AS found, {', '.join(f'round(coalesce(s.{n}, {DEFAULTS[n]}), {DIGITS}) AS {n}' if n.startswith('amt_') else f'coalesce(s.{n}, {DEFAULTS[n]}) AS {n}' for n in FEATURE_NAMES)} FROM asked a LEFT JOIN st s ON a.card_id = s.card_id")
def online_lookup(spark, sf_dir):
    """Every customer asks for their card; most have none and get the defaults."""
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("card_"), F.col("c_custkey").cast("string")).alias("card_id"))
    return _select(asof.lookup(asked, store.store_view(events(spark, sf_dir))), "card_id", "found", *FEATURE_NAMES)


_APART = "abs(a - b) > 1e-6 + 1e-9 * abs(a)"
_DAMAGE = " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST(f.{n} AS DOUBLE) AS a, CAST(b.{n} AS DOUBLE) AS b FROM f JOIN b ON f.card_id = b.card_id" for n in FEATURE_NAMES)


@query("bounded_replay_damage", f"WITH {_ev()}, late AS (SELECT * FROM ev WHERE u > (SELECT max(u) FROM ev) - 604800), {_store_sql('ev', 'f')}, {_store_sql('late', 'b')} SELECT feature, count(*) AS n_cards, count(CASE WHEN {_APART} THEN 1 END) AS n_wrong, avg(CASE WHEN {_APART} THEN 1.0 ELSE 0.0 END) AS wrong_rate, round(max(abs(a - b)), 6) AS max_error, round(avg(abs(a - b)), 6) AS mean_abs_error FROM ({_DAMAGE}) GROUP BY feature")
def bounded_replay_damage(spark, sf_dir):
    rows = events(spark, sf_dir)
    found = store.replay_damage(store.store_view(rows), store.store_view(store.recent(rows, 7)))
    return found.withColumns({c: F.round(c, 6) for c in ("max_error", "mean_abs_error")})


# ---- the second implementation and parity -----------------------------------------------------


def _keyed(spark, sf_dir, policy: str) -> DataFrame:
    rows = events(spark, sf_dir, True).withColumn("u", windows.seconds("event_timestamp"))
    return state.keyed_features(rows, policy, finalize=True)


@query("online_state_batch", f"WITH {_ev(True)}, {_framed()} SELECT transaction_id, {ALL} FROM feat")
def online_state_batch(spark, sf_dir):
    """Scoring rows of the keyed state machine under the policy that holds ties back."""
    return _select(_keyed(spark, sf_dir, "watermark").filter("view = 'scoring'"), "transaction_id", *FEATURE_NAMES)


@query("online_state_arrival", f"WITH {_ARRIVAL} SELECT id AS transaction_id, {ALL} FROM arrival")
def online_state_arrival(spark, sf_dir):
    return _select(_keyed(spark, sf_dir, "arrival").filter("view = 'scoring'"), "transaction_id", *FEATURE_NAMES)


@query("online_store_batch", f"WITH {_ev(True)}, {_store_sql('ev', 'st')} SELECT card_id, top AS committed_ts, {ALL} FROM st")
def online_store_batch(spark, sf_dir):
    return _select(_keyed(spark, sf_dir, "watermark").filter("view = 'store'").withColumnRenamed("u", "committed_ts"), "card_id", "committed_ts", *FEATURE_NAMES)


@query("online_vs_offline_parity", f"WITH {_ev(True)} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_mismatch, CAST(0 AS DOUBLE) AS max_abs_diff, CAST(0 AS DOUBLE) AS mismatch_rate FROM ev" for n in FEATURE_NAMES))
def online_vs_offline_parity(spark, sf_dir):
    offline = windows.trailing_features(events(spark, sf_dir, True))
    online = _keyed(spark, sf_dir, "watermark").filter("view = 'scoring'")
    return parity.feature_report(offline, online).drop("examples")


def _streamed(spark, sf_dir) -> tuple[str, jobs.LatestStore]:
    base = scratch(spark)
    jobs.produce(events(spark, sf_dir, True), f"{base}/wire")
    jobs.features_stream(spark, f"{base}/wire", f"{base}/store", f"{base}/scoring", f"{base}/checkpoint")
    return base, jobs.LatestStore(spark, f"{base}/store")


@query("stream_scoring_view", f"WITH {_ev(True)}, {_framed()} SELECT transaction_id, {ALL} FROM feat")
def stream_scoring_view(spark, sf_dir):
    """Wire messages through the streaming job, in several micro-batches."""
    base, _ = _streamed(spark, sf_dir)
    return _select(spark.read.parquet(f"{base}/scoring"), "transaction_id", *FEATURE_NAMES)


@query("stream_store_view", f"WITH {_ev(True)}, kept AS (SELECT * FROM (SELECT *, max(u) OVER (PARTITION BY card_id) AS newest FROM ev) WHERE u < newest), {_store_sql('kept', 'st')} SELECT card_id, top AS committed_ts, {ALL} FROM st")
def stream_store_view(spark, sf_dir):
    """The store after the stream: each card's newest events still wait for a newer one."""
    _, latest = _streamed(spark, sf_dir)
    return _select(latest.read(), "card_id", "committed_ts", *FEATURE_NAMES)


@query("landing_roundtrip", f"WITH {_ev()} SELECT {', '.join(_CANONICAL)}, u FROM ev WHERE amount >= 0")
def landing_roundtrip(spark, sf_dir):
    base = scratch(spark)
    jobs.produce(events(spark, sf_dir), f"{base}/wire")
    jobs.land_stream(spark, f"{base}/wire", f"{base}/landing", f"{base}/rejects", f"{base}/checkpoint")
    return source.read_landing(spark, f"{base}/landing").select(*_CANONICAL, windows.seconds("event_timestamp").alias("u"))


@query("json_wire", "SELECT CASE WHEN event_id % 4 = 0 THEN 'malformed' WHEN event_id % 4 = 1 THEN 'negative amount' WHEN event_id % 4 = 2 THEN 'missing field' ELSE 'ok' END AS reject, count(*) AS n_rows FROM events GROUP BY 1")
def json_wire(spark, sf_dir):
    """Wire messages that were damaged in three ways: each kind is rejected for its own reason."""
    rows = events(spark, sf_dir)
    part = F.col("transaction_id") % 4
    damaged = rows.withColumn("amount", F.when(part == 1, -F.col("amount") - 1).when(part == 2, F.lit(None)).otherwise(F.col("amount")))
    wire = source.to_wire(damaged).withColumn("part", F.get_json_object("value", "$.transaction_id").cast("long") % 4)
    broken = wire.select(F.when(F.col("part") == 0, F.substring("value", 2, 1000)).otherwise(F.col("value")).alias("value"))
    return source.from_wire(broken).groupBy(F.coalesce("reject", F.lit("ok")).alias("reject")).agg(F.count(F.lit(1)).alias("n_rows"))


_SPOT = 20
_LINEAR = {"amount": 0.004, "amt_mean_24h": -0.003, "txn_count_1h": 0.2, "amt_over_mean_24h": 0.05, "seconds_since_last_txn": -0.000001, "hour_of_day": 0.01}
_REQUESTS = f"""asked AS (SELECT o_orderkey AS transaction_id, 'card_' || CAST(o_custkey AS VARCHAR) AS card_id, (SELECT max(u) FROM ev) + (o_orderkey % 12) * 86400 AS u, o_totalprice / 1000.0 AS amount,
  CASE WHEN o_orderstatus IN ('W', 'C', 'R', 'H', 'S') THEN o_orderstatus ELSE 'W' END AS product_cd FROM orders),
found AS (SELECT a.*, s.card_id IS NOT NULL AS found, {', '.join(f'coalesce(s.{n}, {DEFAULTS[n]}) AS {n}' for n in FEATURE_NAMES)} FROM asked a LEFT JOIN st s ON a.card_id = s.card_id AND s.top >= a.u - {dataset.TTL_SECONDS}),
vec AS (SELECT *, {_ONDEMAND}, hour(make_timestamp(u * 1000000)) AS hour_of_day FROM found)"""


def _requests(spark, sf_dir) -> DataFrame:
    """Orders as requests, up to eleven days after the last event, so that some stored rows have outlived their time."""
    newest = events(spark, sf_dir).agg(F.max(windows.seconds("event_timestamp")).alias("newest"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").crossJoin(F.broadcast(newest)).select(  # one row
        F.col("o_orderkey").alias("transaction_id"), F.concat(F.lit("card_"), F.col("o_custkey").cast("string")).alias("card_id"),
        F.timestamp_seconds(F.col("newest") + F.col("o_orderkey") % 12 * 86400).alias("event_timestamp"), (F.col("o_totalprice") / 1000.0).cast("double").alias("amount"), F.col("o_orderstatus").alias("product_cd"),
    )


@query("score_requests", f"""WITH {_ev()}, {_store_sql('ev', 'st')}, {_REQUESTS}, scored AS (SELECT *, 1 / (1 + exp(-(-1.0 + {' + '.join(f'{n} * {w:f}' for n, w in _LINEAR.items())}))) AS score FROM vec)
SELECT transaction_id, found, {_settled(FEATURE_NAMES + ONDEMAND)}, round(score, 6) AS score, score >= 0.5 AS flagged FROM scored""")
def score_requests(spark, sf_dir):
    """Lookup with a time to live, request-time features, a linear score and the threshold, in one plan."""
    stored = store.store_view(events(spark, sf_dir))
    scored = serving.score_requests(_requests(spark, sf_dir), stored, model.linear_scorer(_LINEAR, -1.0))
    return _select(scored.withColumn("score", F.round("score", 6)), "transaction_id", "found", *FEATURE_NAMES, *ONDEMAND, "score", "flagged")


@query("explain_requests", f"""WITH {_ev()}, {_store_sql('ev', 'st')}, {_REQUESTS}, parts AS ({' UNION ALL '.join(f"SELECT transaction_id, '{n}' AS feature, {n} * {w:f} AS contribution FROM vec" for n, w in _LINEAR.items())}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(contribution) DESC, feature) AS place FROM parts) SELECT transaction_id, feature, round(contribution, 9) AS contribution FROM ranked WHERE place <= 3""")
def explain_requests(spark, sf_dir):
    """The three largest contributions to each request's score."""
    scored = serving.score_requests(_requests(spark, sf_dir), store.store_view(events(spark, sf_dir)), model.linear_scorer(_LINEAR, -1.0))
    top = model.explained(scored, _LINEAR, 3).select("transaction_id", F.explode("top").alias("t"))
    return top.select("transaction_id", "t.feature", F.round("t.contribution", 9).alias("contribution"))


_AT = "CAST(1704067200 + 86400 * (1 + event_id % 40) AS BIGINT)"


@query("snapshot_as_of", f"""WITH {_ev()}, asks AS (SELECT DISTINCT 'card_' || CAST(user_id AS VARCHAR) AS card_id, {_AT} AS at_u FROM events WHERE event_id % 5 = 0),
rows AS (SELECT a.card_id, at_u, b.u AS v, b.amount, b.product_cd FROM asks a LEFT JOIN ev b ON a.card_id = b.card_id AND b.u <= at_u), {_grouped("rows", "snap", lambda w: f"v > at_u - {WINDOWS[w]}", "card_id, at_u", "max(v)", "count(v)")}
SELECT card_id, at_u, {ALL} FROM snap""")
def snapshot_as_of(spark, sf_dir):
    """What the store would have said at given times: its windows end there, not at the card's last event."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 5 = 0")
    asked = raw.select(F.concat(F.lit("card_"), F.col("user_id").cast("string")).alias("card_id"), (F.lit(1704067200) + 86400 * (1 + F.col("event_id") % 40)).cast("long").alias("at_u"))
    return _select(store.snapshot_at(events(spark, sf_dir), asked, "at_u"), "card_id", "at_u", *FEATURE_NAMES)


@query("served_vs_offline", f"""WITH {_ev(True)}, last AS (SELECT card_id, max(u) AS top FROM ev GROUP BY 1), alone AS (SELECT ev.card_id FROM ev JOIN last ON ev.card_id = last.card_id AND u = top GROUP BY 1 HAVING count(*) = 1)
SELECT count(CASE WHEN transaction_id % 11 <> 0 THEN 1 END) AS n_rows, count(CASE WHEN transaction_id % 11 <> 0 AND transaction_id % 7 = 0 THEN 1 END) AS n_mismatch, count(CASE WHEN transaction_id % 11 = 0 THEN 1 END) AS only_offline,
  CAST(0 AS BIGINT) AS only_served, least({_SPOT}, (SELECT count(*) FROM alone)) AS spot_cards, CAST(0 AS BIGINT) AS spot_differ, false AS passed FROM ev""")
def served_vs_offline(spark, sf_dir):
    """Served rows of which some are damaged and some are missing: the report must find them all, and the store must be whole."""
    rows = events(spark, sf_dir, True)
    keyed = checkpoint(_keyed(spark, sf_dir, "watermark"))
    part = F.col("transaction_id")
    served = keyed.filter("view = 'scoring'").filter(part % 11 != 0)
    served = served.withColumns({"amt_max_7d": F.when(part % 7 == 0, float("nan")).otherwise(F.col("amt_max_7d")), "txn_count_7d": F.when(part % 14 == 0, F.col("txn_count_7d") + 1).otherwise(F.col("txn_count_7d"))})
    stored = keyed.filter("view = 'store'").select("card_id", *FEATURE_NAMES)
    return gates.served_report(served, windows.trailing_features(rows), stored, rows, _SPOT)


@query("latency_histogram", f"SELECT l_returnflag AS stage, le, count(CASE WHEN le IS NULL OR l_quantity <= le THEN 1 END) AS n FROM lineitem, (VALUES {', '.join(f'(CAST({b} AS DOUBLE))' for b in serving.BUCKETS)}, (NULL)) v(le) GROUP BY 1, 2")
def latency_histogram(spark, sf_dir):
    return serving.latency_histogram(spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_returnflag", "stage"), "l_quantity", "stage")


# ---- metrics, models, drift -------------------------------------------------------------------


def _curve_sql(score: str) -> str:
    return f"""pts AS (SELECT {score} AS score, sum(is_fraud) AS tp, sum(1 - is_fraud) AS fp FROM ev GROUP BY 1),
run AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) AS tps, sum(fp) OVER (ORDER BY score DESC) AS fps FROM pts), tot AS (SELECT CAST(sum(is_fraud) AS DOUBLE) AS p, CAST(sum(1 - is_fraud) AS DOUBLE) AS q FROM ev),
pr AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(tps AS DOUBLE) AS tps, CAST(tps AS DOUBLE) / CAST(tps + fps AS DOUBLE) AS prec, CAST(tps AS DOUBLE) / p AS rec, p, q FROM run, tot)"""


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Sums of doubles depend on their order: nine digits do not."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("ranking_metrics", f"WITH {_ev()}, {_curve_sql('amount')} SELECT round(sum(tp / p * prec), 9) AS average_precision, round(sum(fp * (2 * tps - tp) / (2.0 * p * q)), 9) AS roc_auc, round(coalesce(max(CASE WHEN rec >= 0.5 THEN prec END), 0.0), 9) AS precision_at_recall_50, round(coalesce(max(CASE WHEN prec >= 0.9 THEN rec END), 0.0), 9) AS recall_at_precision_90 FROM pr")
def ranking_metrics(spark, sf_dir):
    return _rounded(metrics.ranking_metrics(events(spark, sf_dir), "amount", "is_fraud"))


@query("amount_baseline", f"WITH {_ev()}, {_curve_sql('amount')} SELECT round((SELECT CAST(sum(is_fraud) AS DOUBLE) / count(*) FROM ev), 9) AS prevalence, round(sum(tp / p * prec), 9) AS amount_ap FROM pr")
def amount_baseline(spark, sf_dir):
    return _rounded(metrics.baselines(events(spark, sf_dir)).select("prevalence", "amount_ap"))


_PERCENTILES = "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 9) AS {n}" for n, q in metrics.PERCENTILES.items()) + ", round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS max, count(l_extendedprice) AS n FROM lineitem"


@query("latency_percentiles", _PERCENTILES)
def latency_percentiles(spark, sf_dir):
    found = metrics.latency_profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice")
    return found.select(*[F.round(n, 9).alias(n) for n in metrics.PERCENTILES], F.round("mean", 4).alias("mean"), "max", "n")


@query("pooled_percentiles", _PERCENTILES)
def pooled_percentiles(spark, sf_dir):
    """Samples of seven parts of unequal size, pooled."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", "l_extendedprice")
    parts = [rows.filter(F.col("l_linenumber") == i).select("l_extendedprice") for i in range(1, 7)] + [rows.filter("l_linenumber > 6").select("l_extendedprice")]
    found = metrics.merged_latency(parts, "l_extendedprice")
    return found.select(*[F.round(n, 9).alias(n) for n in metrics.PERCENTILES], F.round("mean", 4).alias("mean"), "max", "n")


_COIN = "CAST('0x' || substr(md5('42/' || CAST(transaction_id AS VARCHAR)), 1, {n}) AS BIGINT)"


@query("random_baseline", f"WITH {_ev(name='seen')}, ev AS (SELECT *, {_COIN.format(n=12)} AS noise FROM seen), {_curve_sql('noise')} SELECT round(sum(tp / p * prec), 9) AS random_ap FROM pr")
def random_baseline(spark, sf_dir):
    """Average precision of a seeded random score."""
    return _rounded(metrics.baselines(events(spark, sf_dir)).select("random_ap"))


@query("disjoint_halves", f"WITH {_ev()} SELECT transaction_id, {_COIN.format(n=8)} % 2 AS half FROM ev")
def disjoint_halves(spark, sf_dir):
    first, second = drift.halves(events(spark, sf_dir))
    return first.select("transaction_id", F.lit(0).cast("long").alias("half")).unionByName(second.select("transaction_id", F.lit(1).cast("long").alias("half")))


@query("validated_requests", """SELECT n_nationkey AS transaction_id, CASE WHEN n_nationkey % 5 = 0 THEN 'missing card' WHEN n_nationkey % 3 = 0 THEN 'bad amount' WHEN n_nationkey % 7 NOT IN (0) AND n_nationkey % 7 * 5 > 20 THEN 'bad top_k' END AS reject FROM nation""")
def validated_requests(spark, sf_dir):
    """A batch of requests with a missing card, a negative or missing amount, and a top_k out of bounds or left out."""
    k = F.col("n_nationkey")
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        k.cast("long").alias("transaction_id"), F.when(k % 5 != 0, F.concat(F.lit("card_"), k.cast("string"))).alias("card_id"),
        F.when(k % 3 != 0, k.cast("double")).when(k % 2 == 0, -1.0).alias("amount"), F.when(k % 7 != 0, k % 7 * 5).cast("int").alias("top_k"),
    )
    return gates.validated_requests(asked).select("transaction_id", "reject")


@query("json_report", "SELECT n_regionkey AS region, CASE WHEN n_regionkey % 2 = 0 THEN CAST(count(*) AS DOUBLE) END AS share FROM nation GROUP BY 1")
def json_report(spark, sf_dir):
    """A report with values that JSON lacks, read back: NaN and infinities are null."""
    path = f"{scratch(spark)}/report"
    found = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.count(F.lit(1)).cast("double").alias("n")).collect()
    odd = {1: float("nan"), 3: float("inf")}
    gates.write_report(spark, [{"region": r["n_regionkey"], "share": odd.get(r["n_regionkey"], r["n"])} for r in found], path)
    return spark.read.schema("region long, share double").json(path)


@query("model_scores")
def model_scores(spark, sf_dir):
    """Boosted trees fitted on the first slice in time score the last one."""
    split = dataset.chronological_split(dataset.training_set(events(spark, sf_dir)))
    train = split.filter("split = 'train'")
    maps = fx.category_map(train)
    fitted = model.fit(train, maps, maxIter=5, maxDepth=3)
    return model.score(split.filter("split = 'test'"), fitted, maps).select("transaction_id", "is_fraud", "score", "flagged")


@query("explain_trees")
def explain_trees(spark, sf_dir):
    """The three inputs that weigh most in each score of boosted trees, by exact Shapley values."""
    split = dataset.chronological_split(dataset.training_set(events(spark, sf_dir)))
    train = split.filter("split = 'train'")
    maps = fx.category_map(train)
    fitted = model.fit(train, maps, maxIter=5, maxDepth=3)
    scored = model.tree_scorer(fitted, maps)(split.filter("split = 'test'"))
    top = model.explained(scored, MODEL_INPUTS, 3).select("transaction_id", "score", F.explode("top").alias("t"))
    return top.select("transaction_id", "score", "t.feature", "t.contribution")


@query("inject_amount", f"WITH {_ev()} SELECT transaction_id, amount * 4.0 AS amount FROM ev")
def inject_amount(spark, sf_dir):
    return drift.inject_shift(events(spark, sf_dir), "amount").select("transaction_id", "amount")


@query("inject_product", f"WITH {_ev()} SELECT transaction_id, 'C' AS product_cd FROM ev")
def inject_product(spark, sf_dir):
    return drift.inject_shift(events(spark, sf_dir), "product").select("transaction_id", "product_cd")


_VELOCITY = "gaps AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY card_id ORDER BY us, transaction_id)) // 20, 0) AS gap, min(us) OVER (PARTITION BY card_id) AS begun FROM ev)"


@query("inject_velocity", f"WITH {_ev()}, {_VELOCITY} SELECT transaction_id, CAST(begun + sum(gap) OVER (PARTITION BY card_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS us FROM gaps")
def inject_velocity(spark, sf_dir):
    return drift.inject_shift(events(spark, sf_dir), "velocity").select("transaction_id", _micros().alias("us"))


_MONITORED = ["amount", "txn_count_7d", "amt_max_24h", "amt_sum_24h"]


def _drift_sql(sides: str, name: str, columns: list[str]) -> str:
    """A common table expression of (column, score, ks) over a table of the columns and side."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(coalesce(CAST({c} AS DOUBLE), 0.0), 9) AS x, side FROM {sides}" for c in columns)
    return f"""{name}_pts AS (SELECT "column", x, CAST(sum(1 - side) AS DOUBLE) AS r, CAST(sum(side) AS DOUBLE) AS c FROM ({long}) GROUP BY 1, 2),
{name}_run AS (SELECT *, sum(r) OVER (PARTITION BY "column" ORDER BY x) AS rs, sum(c) OVER (PARTITION BY "column" ORDER BY x) AS cs, coalesce(lead(x) OVER (PARTITION BY "column" ORDER BY x) - x, 0.0) AS dx FROM {name}_pts),
{name}_mom AS (SELECT "column", sum(r) AS nr, sum(c) AS nc, sum(x * r) AS sx, sum(x * x * r) AS sxx FROM {name}_pts GROUP BY 1),
{name}_dist AS (SELECT {name}_run."column", sum(abs(rs / nr - cs / nc) * dx) AS d, max(abs(rs / nr - cs / nc)) AS ks, max(sqrt(greatest(sxx / nr - (sx / nr) * (sx / nr), 0.0))) AS spread FROM {name}_run JOIN {name}_mom ON {name}_run."column" = {name}_mom."column" GROUP BY 1),
{name} AS (SELECT "column", CASE WHEN spread > 0 THEN d / spread WHEN d > 0 THEN 1.0 ELSE 0.0 END AS score, ks FROM {name}_dist)"""


def _decision_sql(scores: str) -> str:
    keys = ", ".join(f"'{k}'" for k in KEY_FEATURES)
    return f"""SELECT *, CAST(n_drifted AS DOUBLE) / n_columns AS drift_share, n_drifted >= 0.3 * n_columns OR key_drifted <> '' AS alerted,
  CASE WHEN NOT (n_drifted >= 0.3 * n_columns OR key_drifted <> '') THEN 'quiet' WHEN n_drifted >= 0.6 * n_columns THEN 'critical' ELSE 'warning' END AS severity
FROM (SELECT count(*) AS n_columns, count(CASE WHEN score > 0.1 THEN 1 END) AS n_drifted, coalesce(string_agg(CASE WHEN score > 0.1 AND "column" IN ({keys}) THEN "column" END, ',' ORDER BY "column"), '') AS key_drifted FROM {scores})"""


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(CAST({c} AS DOUBLE), 9) AS x, side FROM sides" for c in _MONITORED)
_SIDES = f"{_ev()}, shifted AS (SELECT * REPLACE (amount * 4.0 AS amount) FROM ev), {_framed('ev', 'ref')}, {_framed('shifted', 'cur')}, sides AS (SELECT {', '.join(_MONITORED)}, 0 AS side FROM ref UNION ALL SELECT {', '.join(_MONITORED)}, 1 AS side FROM cur)"
_DRIFT = f"{_SIDES}, {_drift_sql('sides', 'scores', _MONITORED)}"


def _drift_pair(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir)
    current = windows.trailing_features(drift.inject_shift(rows, "amount"))
    return drift.drift_scores(windows.trailing_features(rows), current, _MONITORED)


@query("drift_scores", f'WITH {_DRIFT} SELECT "column", round(score, 6) AS score, round(ks, 6) AS ks, score > 0.1 AS drifted FROM scores')
def drift_scores(spark, sf_dir):
    return _rounded(_drift_pair(spark, sf_dir), 6)


@query("drift_decision", f"WITH {_DRIFT} {_decision_sql('scores')}")
def drift_decision(spark, sf_dir):
    return drift.drift_decision(_drift_pair(spark, sf_dir))


_WARM_UP = WINDOWS["7d"]
_COMPARED = [c for c in MONITORED if c not in drift.CUMULATIVE]


def _experiment_sql() -> str:
    """Every scenario of the experiment: shifted streams, their features, tails, halves, scores and decisions."""
    streams = {
        "none": "none_ev AS (SELECT * FROM ev)",
        "amount": "amount_ev AS (SELECT * REPLACE (amount * 4.0 AS amount) FROM ev)",
        "product": "product_ev AS (SELECT * REPLACE ('C' AS product_cd) FROM ev)",
        "velocity": f"{_VELOCITY}, moved AS (SELECT * EXCLUDE (gap, begun) REPLACE (CAST(begun + sum(gap) OVER (PARTITION BY card_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS us) FROM gaps), velocity_ev AS (SELECT * REPLACE (us // 1000000 AS u) FROM moved)",
    }
    parts = [_ev()]
    for kind, made in streams.items():
        parts += [made, _framed(f"{kind}_ev", f"{kind}_feat")]
        parts.append(f"{kind}_full AS (SELECT *, {_ONDEMAND}, row_number() OVER (ORDER BY u, transaction_id) AS place, count(*) OVER () AS n FROM {kind}_feat)")
        parts.append(f"{kind}_tail AS (SELECT * FROM {kind}_full WHERE place > n - CAST(floor(n * 0.15) AS BIGINT))")
    parts.append(f"earlier AS (SELECT * FROM none_full WHERE transaction_id NOT IN (SELECT transaction_id FROM none_tail) AND u >= (SELECT min(u) FROM ev) + {_WARM_UP})")
    parts.append("coin AS (SELECT *, CAST(('0x' || substr(md5('42/' || transaction_id), 1, 8)) AS BIGINT) % 2 AS half FROM earlier)")
    columns = ", ".join(_COMPARED)
    pairs = {"null": ("(SELECT * FROM coin WHERE half = 0)", "(SELECT * FROM coin WHERE half = 1)"), "temporal": ("earlier", "none_tail")} | {k: ("earlier", f"{k}_tail") for k in drift.KINDS[1:]}
    for name, (old, new) in pairs.items():
        parts.append(f"{name}_sides AS (SELECT {columns}, 0 AS side FROM {old} UNION ALL SELECT {columns}, 1 AS side FROM {new})")
        parts.append(_drift_sql(f"{name}_sides", f"{name}_scores", _COMPARED))
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT '{name}' AS scenario, * FROM ({_decision_sql(f'{name}_scores')})" for name in pairs)


@query("drift_experiment", _experiment_sql())
def drift_experiment(spark, sf_dir):
    """Columns that grow with time by themselves are left out, and so is the first week, when windows are not full."""
    return drift.drift_experiment(events(spark, sf_dir), warm_up=_WARM_UP, columns=_COMPARED)


_WINDOW = 500


@query("served_drift", f"""WITH {_ev()}, {_framed()}, ref AS (SELECT *, {_ONDEMAND} FROM feat), newest AS (SELECT * FROM ref ORDER BY u DESC, transaction_id DESC LIMIT {_WINDOW}),
sides AS (SELECT {', '.join(_COMPARED)}, 0 AS side FROM ref UNION ALL SELECT {', '.join(_COMPARED)}, 1 AS side FROM newest), {_drift_sql('sides', 'scores', _COMPARED)}
SELECT "column", round(score, 6) AS score, round(ks, 6) AS ks, score > 0.1 AS drifted FROM scores""")
def served_drift(spark, sf_dir):
    """What was served last, joined to its events, against the features of all events."""
    rows = events(spark, sf_dir)
    offline = windows.trailing_features(rows)
    served = offline.select("transaction_id", windows.seconds("event_timestamp").alias("u"), *FEATURE_NAMES)
    return _rounded(drift.served_drift(served, rows, offline.withColumns(fx.ondemand()), _WINDOW, _COMPARED), 6)


@query("drift_verdict", """SELECT part AS "column", method, value, threshold, CASE WHEN part % 3 = 0 THEN value < threshold WHEN part % 7 = 0 THEN NULL ELSE value > threshold END AS drifted
FROM (SELECT p_partkey AS part, CASE p_partkey % 3 WHEN 0 THEN 'K-S p_value' WHEN 1 THEN 'Wasserstein distance (normed)' ELSE 'PSI' END AS method,
  CASE WHEN p_partkey % 7 = 0 AND p_partkey % 3 <> 0 THEN NULL ELSE (p_partkey % 100) / 100.0 END AS value, CAST(CASE p_partkey % 3 WHEN 0 THEN 0.05 ELSE 0.1 END AS DOUBLE) AS threshold FROM part)""")
def drift_verdict(spark, sf_dir):
    """Findings of three methods, of which one gives probabilities; some are empty."""
    key = F.col("p_partkey")
    found = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        key.alias("column"),
        F.when(key % 3 == 0, "K-S p_value").when(key % 3 == 1, "Wasserstein distance (normed)").otherwise("PSI").alias("method"),
        F.when((key % 7 != 0) | (key % 3 == 0), (key % 100) / 100.0).alias("value"),
        F.when(key % 3 == 0, 0.05).otherwise(0.1).alias("threshold"),
    )
    return drift.verdict(found)


@query("stability_index", f"""WITH {_SIDES}, lng AS (SELECT "column", x, side FROM ({_LONG})), rng AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM lng WHERE side = 0 GROUP BY 1),
cnt AS (SELECT lng."column", CASE WHEN hi > lo THEN greatest(0, least(9, floor((x - lo) / (hi - lo) * 10))) ELSE 0 END AS bin, CAST(sum(1 - side) AS DOUBLE) AS r, CAST(sum(side) AS DOUBLE) AS c FROM lng JOIN rng ON lng."column" = rng."column" GROUP BY 1, 2),
sh AS (SELECT "column", greatest(r / sum(r) OVER (PARTITION BY "column"), 1e-4) AS p, greatest(c / sum(c) OVER (PARTITION BY "column"), 1e-4) AS q FROM cnt) SELECT "column", round(sum((q - p) * ln(q / p)), 6) AS psi FROM sh GROUP BY 1""")
def stability_index(spark, sf_dir):
    rows = events(spark, sf_dir)
    current = windows.trailing_features(drift.inject_shift(rows, "amount"))
    return _rounded(drift.stability_index(windows.trailing_features(rows), current, _MONITORED), 6)


# ---- samples and ends -------------------------------------------------------------------------


@query("key_sample", f"WITH {_ev()}, chosen AS (SELECT card_id FROM (SELECT DISTINCT card_id FROM ev) ORDER BY md5('7/' || card_id), card_id LIMIT 20) SELECT transaction_id, card_id FROM ev WHERE card_id IN (SELECT card_id FROM chosen)")
def key_sample(spark, sf_dir):
    return source.sample_keys(events(spark, sf_dir), 20).select("transaction_id", "card_id")


@query("tail_window", f"WITH {_ev()} SELECT transaction_id, u FROM ev ORDER BY us DESC, transaction_id DESC LIMIT 500")
def tail_window(spark, sf_dir):
    return source.tail(events(spark, sf_dir), 500).select("transaction_id", windows.seconds("event_timestamp").alias("u"))


@query("topk_shift", f'WITH {_DRIFT} SELECT "column", round(score, 6) AS score FROM scores WHERE score > 0.1 ORDER BY abs(score) DESC, 1 LIMIT 6')
def topk_shift(spark, sf_dir):
    return _rounded(drift.worst_columns(_drift_pair(spark, sf_dir)).select("column", "score"), 6)


def _uniform_sql(name: str, seed: int = 7) -> str:
    return f"(CAST(CAST('0x' || substr(md5('{seed}/{name}/' || id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"


@query("synthetic_profile", f"""WITH ids AS (SELECT unnest(range(1, 5001)) AS id),
made AS (SELECT id, least(CAST(floor(pow({_uniform_sql('owner')} * (pow(201.0, 0.2) - 1) + 1, 1 / 0.2)) AS BIGINT), 200) AS card,
  round(exp(sqrt(-2 * ln({_uniform_sql('r')})) * cos(2 * 3.141592653589793 * {_uniform_sql('phi')}) * 1.1 + 3.4), 2) AS amount, {_uniform_sql('product')} AS p, {_uniform_sql('label')} AS label,
  CASE WHEN {_uniform_sql('tie')} < 0.08 THEN 0 ELSE CAST(floor(-ln({_uniform_sql('gap')}) * 18000.0) AS BIGINT) + 1 END AS gap FROM ids),
large AS (SELECT quantile_disc(amount, 0.97) AS large FROM made)
SELECT CASE WHEN p < 0.7 THEN 'W' WHEN p < 0.82 THEN 'C' WHEN p < 0.9 THEN 'R' WHEN p < 0.96 THEN 'H' ELSE 'S' END AS product_cd, count(*) AS n_rows, count(DISTINCT card) AS n_cards, round(avg(amount), 4) AS mean_amount,
  round(avg(CASE WHEN label < CASE WHEN amount > large THEN 0.06 ELSE 0.01 END THEN 1.0 ELSE 0.0 END), 9) AS label_rate FROM made, large GROUP BY 1""")
def synthetic_profile(spark, sf_dir):
    """The generator's events: counts, cards, amounts and labels by product.  It reads no table: its rows are a function of the seed."""
    made = source.synthetic(spark)
    return made.groupBy("product_cd").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("card_id").alias("n_cards"), F.round(F.avg("amount"), 4).alias("mean_amount"), F.round(F.avg("is_fraud"), 9).alias("label_rate"))

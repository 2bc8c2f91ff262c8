"""Scoring of requests: stored features, request-time features, encoding, a model, and a threshold, in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.features import calendar, ondemand
from millrace.operators.asof import lookup
from millrace.operators.dataset import TTL_SECONDS
from millrace.operators.windows import require, seconds
from millrace.spec import CATEGORICAL, FALLBACK_PRODUCT, FEATURE_NAMES, PRODUCTS, UNKNOWN

#: upper bounds, in milliseconds, of a latency histogram
BUCKETS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0)


def request_rows(requests: DataFrame, store: DataFrame, ttl_seconds: int | None = TTL_SECONDS) -> DataFrame:
    """Requests (card_id, event_timestamp, amount, product_cd and the other model inputs) with every model input.

    Stored rows older than the time to live count as absent; absent cards have the defaults and
    found = false.  Unknown codes and missing strings get their fallbacks."""
    require(requests, "card_id", "event_timestamp", "amount", "product_cd")
    code = F.when(F.col("product_cd").isin(*PRODUCTS), F.col("product_cd")).otherwise(F.lit(FALLBACK_PRODUCT))
    filled = {"product_cd": code} | {c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in CATEGORICAL if c != "product_cd" and c in requests.columns}
    asked = requests.withColumns(filled)
    stored = lookup(asked, store, at=seconds("event_timestamp"), ttl_seconds=ttl_seconds)
    return stored.withColumns(ondemand() | calendar())


def score_requests(requests: DataFrame, store: DataFrame, scorer: Callable[[DataFrame], DataFrame], threshold: float = 0.5, ttl_seconds: int | None = TTL_SECONDS) -> DataFrame:
    """Requests with all model inputs, a score, and whether it reaches the threshold.

    `scorer` is any function that adds `score`: `model.scorer` of a fitted pipeline, or `model.linear_scorer`."""
    return scorer(request_rows(requests, store, ttl_seconds)).withColumn("flagged", F.col("score") >= threshold)


def latency_histogram(samples: DataFrame, value: str = "ms", by: str | None = None) -> DataFrame:
    """(by, le, n): how many samples are at or under each bound, and in all (le null)."""
    keys = [by] if by else []
    counts = samples.groupBy(*keys).agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(f"n{i}") for i, b in enumerate(BUCKETS)], F.count(value).alias("n_all"))
    rows = [F.struct(F.lit(b).alias("le"), F.col(f"n{i}").alias("n")) for i, b in enumerate(BUCKETS)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("n_all").alias("n"))]
    return counts.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def served_features(scored: DataFrame) -> DataFrame:
    """The stored features as they were used, by transaction, for comparison with the offline ones."""
    return scored.select("transaction_id", "card_id", *FEATURE_NAMES)

"""Ranking metrics from counts by score, and exact percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import quantiles, running_sums
from millrace.storage import checkpoint

PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score: its positives and negatives, and those at or above it."""
    points = checkpoint(df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label).cast("long")).alias("tp"), F.sum(1 - F.col(label).cast("long")).alias("fp")))
    return running_sums(points, "score", {"tps": "tp", "fps": "fp"}, descending=True)


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision (a step sum), ROC AUC, best precision at recall 0.5 or more, best recall at precision 0.9 or more (0 if none)."""
    points = curve(df, score, label)
    totals = points.agg(F.sum("tp").alias("positives"), F.sum("fp").alias("negatives"))
    at = points.join(F.broadcast(totals))  # one row of totals
    precision, recall = F.col("tps") / (F.col("tps") + F.col("fps")), F.col("tps") / F.col("positives")
    return at.agg(
        F.sum(F.col("tp") / F.col("positives") * precision).alias("average_precision"),
        F.sum(F.col("fp") * (2 * F.col("tps") - F.col("tp")) / (2.0 * F.col("positives") * F.col("negatives"))).alias("roc_auc"),
        F.coalesce(F.max(F.when(recall >= 0.5, precision)), F.lit(0.0)).alias("precision_at_recall_50"),
        F.coalesce(F.max(F.when(precision >= 0.9, recall)), F.lit(0.0)).alias("recall_at_precision_90"),
    )


def baselines(df: DataFrame, label: str = "is_fraud", amount: str = "amount", key: str = "transaction_id", seed: int = 42) -> DataFrame:
    """Prevalence, and the average precision of a seeded random score and of the amount alone."""
    noise = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double")
    rows = df.withColumn("_noise", noise)
    random = ranking_metrics(rows, "_noise", label).select(F.col("average_precision").alias("random_ap"))
    by_amount = ranking_metrics(rows, amount, label).select(F.col("average_precision").alias("amount_ap"))
    return df.agg(F.avg(label).alias("prevalence")).join(F.broadcast(random)).join(F.broadcast(by_amount))  # one row each


def latency_profile(df: DataFrame, value: str) -> DataFrame:
    """Exact interpolating percentiles with mean, max and count; no task sees all values."""
    found = quantiles(df, value, list(PERCENTILES.values()))
    return df.agg(*[F.lit(x).cast("double").alias(n) for n, x in zip(PERCENTILES, found, strict=True)], F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(value).alias("n"))


def merged_latency(parts: list[DataFrame], value: str) -> DataFrame:
    """Percentiles of pooled samples, not of the parts' percentiles."""
    pooled = parts[0]
    for p in parts[1:]:
        pooled = pooled.unionByName(p)
    return latency_profile(pooled, value)

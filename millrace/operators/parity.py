"""Value-by-value comparison of two computations of the same features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.features import is_close
from millrace.spec import FEATURES

EXAMPLES = 5


def _differs(name: str, dtype: str, nan_equal: bool = True) -> Column:
    a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
    if not nan_equal:
        near = (a == b) if dtype == "int64" else is_close(a, b) & ~F.isnan(a) & ~F.isnan(b)
        return ~F.coalesce(near, F.lit(False))
    return ~a.eqNullSafe(b) if dtype == "int64" else ~F.coalesce(is_close(a, b), a.isNull() & b.isNull())


def paired(left: DataFrame, right: DataFrame, key: str = "transaction_id") -> DataFrame:
    """(key, feature, left value, right value, differs) of the rows that both have."""
    both = left.alias("a").join(right.alias("b"), key)
    rows = [F.struct(F.lit(f.name).alias("feature"), F.col(f"a.{f.name}").cast("double").alias("left"), F.col(f"b.{f.name}").cast("double").alias("right"), _differs(f.name, f.dtype).alias("differs")) for f in FEATURES]
    return both.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")


def feature_report(left: DataFrame, right: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Per feature: rows, mismatches, rate, largest difference, and up to EXAMPLES keys of mismatches (the smallest)."""
    pairs = paired(left, right, key)
    examples = F.slice(F.array_sort(F.collect_list(F.when(F.col("rank") <= EXAMPLES, F.col(key)))), 1, EXAMPLES)
    ranked = pairs.filter("differs").withColumn("rank", F.row_number().over(Window.partitionBy("feature").orderBy(key)))
    shown = ranked.filter(F.col("rank") <= EXAMPLES).groupBy("feature").agg(examples.alias("examples"))
    counts = pairs.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("differs"), 1)).alias("n_mismatch"),
        F.coalesce(F.max(F.when(F.col("differs"), F.abs(F.col("left") - F.col("right")))), F.lit(0.0)).alias("max_abs_diff"),
    )
    return counts.join(shown, "feature", "left").withColumn("mismatch_rate", F.col("n_mismatch") / F.col("n_rows"))


def row_report(left: DataFrame, right: DataFrame, key: str = "transaction_id", nan_equal: bool = True) -> DataFrame:
    """One row: rows compared, rows with any mismatch, keys that only one side has, and whether all agree.

    Unless nan_equal, a null or NaN on either side is a mismatch."""
    any_differs = F.lit(False)
    for f in FEATURES:
        any_differs = any_differs | _differs(f.name, f.dtype, nan_equal)
    # one pass over each side
    names = [f.name for f in FEATURES]
    a, b = (df.select(key, F.lit(True).alias("has"), *names).alias(n) for df, n in ((left, "a"), (right, "b")))
    one = a.join(b, key, "full").agg(
        F.count(F.when(F.col("a.has") & F.col("b.has"), 1)).alias("n_rows"),
        F.count(F.when(F.col("a.has") & F.col("b.has") & any_differs, 1)).alias("n_mismatch"),
        F.count(F.when(F.col("b.has").isNull(), 1)).alias("only_left"),
        F.count(F.when(F.col("a.has").isNull(), 1)).alias("only_right"),
    )
    return one.withColumn("passed", (F.col("n_mismatch") == 0) & (F.col("only_left") == 0) & (F.col("only_right") == 0))

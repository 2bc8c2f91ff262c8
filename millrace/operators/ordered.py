"""Running sums, positions and quantiles over a total order, without bringing all rows to one task.

Rows are cut into ranges of the ordering column by approximate quantiles; sums run within a range,
and the ranges' own totals, one row each, give the offsets.  The number of ranges follows the
number of rows, so that a range has about RANGE_ROWS of them; the cuts are on the driver, some
thousands of numbers at most (MOST_RANGES for each order)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import checkpoint

LEAST_RANGES = 16
MOST_RANGES = 4096
RANGE_ROWS = 250_000


def running_sums(
    df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, ties: tuple[str, ...] = (), within: str | None = None, following: str | None = None, ranges: int | None = None
) -> DataFrame:
    """df with, for each new name, the running sum of a column up to and including the row.

    df is read four times, so it should be a table or a checkpoint.

    Rows that are equal in `order` stay in one range and are told apart by `ties`.  `within` is a
    column of few values that each have a total order, and cuts, of their own.  `following` names a
    column for the next row's value of `order` (null at the end)."""
    rows = df if within else df.withColumn("_w", F.lit(0))
    group = within or "_w"
    counts = {r[0]: r[1] for r in rows.groupBy(group).agg(F.count(F.lit(1))).collect()}
    if ranges is None:
        most = max(counts.values(), default=0)
        ranges = max(LEAST_RANGES, min(MOST_RANGES, -(-most // RANGE_ROWS)))
    quantiles = [i / ranges for i in range(1, ranges)]
    found = rows.groupBy(group).agg(F.percentile_approx(order, quantiles, 10 * ranges).alias("cuts")).collect()
    table = [(r[0], sorted({float(c) for c in r["cuts"] or []})) for r in found]
    cuts = df.sparkSession.createDataFrame(table, f"{group} {rows.schema[group].dataType.simpleString()}, _cuts array<double>")
    # a row for each order, with MOST_RANGES numbers at most
    placed = rows.join(F.broadcast(cuts), group, "left")
    place = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < F.col(order)).cast("int")) if ranges <= 64 else _halved(order, ranges)
    rows = placed.withColumn("_range", F.coalesce(place, F.lit(0))).drop("_cuts")
    direction = [F.desc(order) if descending else F.asc(order), *ties]
    own = Window.partitionBy(group, "_range").orderBy(*direction)
    edge = (F.max if descending else F.min)(order).alias("_edge")
    totals = rows.groupBy(group, "_range").agg(edge, *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    step = Window.partitionBy(group).orderBy(F.desc("_range") if descending else F.asc("_range"))
    before = step.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_range", F.lead("_edge").over(step).alias("_next"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()], F.lead(order).over(own).alias("_after"))
    joined = run.join(F.broadcast(offsets), [group, "_range"])  # a row for each range
    after = [F.coalesce("_after", "_next").alias(following)] if following else []
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in sums], *after)


def _halved(order: str, ranges: int) -> F.Column:
    """The number of cuts under the value, by halving: log2(ranges) looks at the array of cuts."""
    steps = [1 << i for i in range((ranges - 1).bit_length(), -1, -1)]
    look = F.array(*[F.lit(s) for s in steps])
    return F.aggregate(look, F.lit(0), lambda low, step: low + F.when(F.get("_cuts", low + step - 1) < F.col(order), step).otherwise(0))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact interpolating quantiles: the rows at the positions that they lie between, found by running counts of values."""
    points = checkpoint(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")))
    run = running_sums(points, "x", {"upto": "n"})
    total = run.agg(F.max("upto")).first()[0]
    if not total:
        return [None] * len(shares)
    places = [s * (total - 1) for s in shares]
    asked = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
    hit = F.lit(False)
    for p in asked:
        hit = hit | ((F.col("upto") - F.col("n") <= p) & (F.col("upto") > p))
    rows = [(r["x"], r["upto"] - r["n"], r["upto"]) for r in run.filter(hit).select("x", "n", "upto").collect()]
    at = {p: next(x for x, a, b in rows if a <= p < b) for p in asked}
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]

"""Column expressions: request-time features, calendar, encodings, scrubbing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import seconds
from millrace.spec import CATEGORICAL, NO_GAP, NO_LAST, NUMERIC, PRODUCTS, RATIO_CAP, RATIO_EPSILON


def capped_ratio(amount: Column, base: Column) -> Column:
    return F.when(base > 0, F.least(amount / (base + RATIO_EPSILON), F.lit(RATIO_CAP))).otherwise(0.0)


def ondemand(event_seconds: Column | None = None) -> dict[str, Column]:
    """The four request-time features from stored features and the request; an unknown product has frequency 0."""
    at = seconds("event_timestamp").cast("double") if event_seconds is None else event_seconds.cast("double")
    same = F.coalesce(*[F.when(F.col("product_cd") == p, F.col(f"product_{p}_count_7d")) for p in PRODUCTS], F.lit(0))
    return {
        "amt_over_mean_24h": capped_ratio(F.col("amount"), F.col("amt_mean_24h")),
        "amt_over_max_7d": capped_ratio(F.col("amount"), F.col("amt_max_7d")),
        "product_freq_7d": F.when(F.col("txn_count_7d") > 0, same / F.col("txn_count_7d")).otherwise(0.0),
        "seconds_since_last_txn": F.when(F.col("last_txn_unixtime") > NO_LAST, at - F.col("last_txn_unixtime")).otherwise(NO_GAP),
    }


def calendar(ts: str = "event_timestamp") -> dict[str, Column]:
    """Hour, and day of week from Monday = 0."""
    return {"hour_of_day": F.hour(ts).cast("long"), "day_of_week": F.weekday(ts).cast("long")}


def finite(x: Column) -> Column:
    """NaN, infinities and null to 0."""
    value = x.cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def json_number(x: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def categories(train: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """(column, values): the sorted categories of each column; null counts as unknown."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.distinct().groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values"))


#: a column of more values is no category of a model
MOST_CATEGORIES = 10_000


def category_map(train: DataFrame, columns: list[str] = CATEGORICAL) -> dict[str, list[str]]:
    """The same on the driver, for a model's metadata; a column of over MOST_CATEGORIES values is refused before any is brought there."""
    counts = train.agg(*[F.countDistinct(F.col(c).cast("string")).alias(c) for c in columns]).first().asDict()
    if wide := [c for c, n in counts.items() if n > MOST_CATEGORIES]:
        raise ValueError(f"too many values for categories: {wide}")
    return {r["column"]: r["values"] for r in categories(train, columns).collect()}


def ordinal(column: str, values: list[str]) -> Column:
    """The place of the value in the sorted categories; -1 if it is not among them."""
    places = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)]) if values else F.lit(None).cast("map<string,int>")
    return F.coalesce(F.try_element_at(places, F.coalesce(F.col(column).cast("string"), F.lit("unknown"))), F.lit(-1)).cast("long")


def encode(df: DataFrame, maps: dict[str, list[str]]) -> DataFrame:
    """Model inputs as numbers: categories by place, null numbers 0."""
    done = {c: ordinal(c, v) for c, v in maps.items()} | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC if c in df.columns}
    return df.withColumns(done)


def top_contributions(values: dict[str, Column], k: int) -> Column:
    """The k largest by absolute value, as an array of (feature, contribution)."""
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("contribution")) for n, v in values.items()])
    by_size = F.array_sort(F.transform(rows, lambda r: F.struct((-F.abs(r["contribution"])).alias("order"), r["feature"].alias("feature"), r["contribution"].alias("contribution"))))
    return F.transform(F.slice(by_size, 1, k), lambda r: F.struct(r["feature"].alias("feature"), r["contribution"].alias("contribution")))


def is_close(a: Column, b: Column, absolute: float = 1e-6, relative: float = 1e-9) -> Column:
    """|a - b| <= absolute + relative * |b|, with NaN equal to NaN."""
    return (F.isnan(a) & F.isnan(b)) | (F.abs(a - b) <= absolute + relative * F.abs(b))

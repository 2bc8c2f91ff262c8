"""Where events come from and go to: CSV, Parquet, landing files, wire JSON, a generator."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.spec import EVENT_COLUMNS, EVENT_SCHEMA, FALLBACK_PRODUCT, PRODUCTS, UNKNOWN

# The start of the raw files' clock, and the raw columns that are read.
EPOCH = 1512086400  # 2017-12-01 00:00:00 UTC
RAW_COLUMNS = {
    "TransactionID": "long", "TransactionDT": "long", "TransactionAmt": "double", "ProductCD": "string", "card1": "double",
    "card4": "string", "card6": "string", "P_emaildomain": "string", "addr1": "double", "dist1": "double", "isFraud": "int",
}


def known_product(code: Column) -> Column:
    return F.when(code.isin(*PRODUCTS), code).otherwise(F.lit(FALLBACK_PRODUCT))


def or_unknown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(UNKNOWN))


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Only the columns of RAW_COLUMNS, whatever else the file has and in any order of columns."""
    header = spark.read.csv(path, header=True)
    missing = [c for c in RAW_COLUMNS if c not in header.columns]
    if missing:
        raise KeyError(f"raw file lacks {missing}")
    return header.select(*[F.col(c).cast(t).alias(c) for c, t in RAW_COLUMNS.items()])


def canonical(raw: DataFrame) -> DataFrame:
    """Raw columns to the event schema: null card is -1, other codes than the known ones are W, null strings are unknown."""
    return raw.select(
        F.col("TransactionID").cast("long").alias("transaction_id"),
        F.concat(F.lit("card_"), F.coalesce(F.col("card1"), F.lit(-1)).cast("long").cast("string")).alias("card_id"),
        F.timestamp_seconds(F.col("TransactionDT") + EPOCH).alias("event_timestamp"),
        F.col("TransactionAmt").cast("double").alias("amount"),
        known_product(F.col("ProductCD")).alias("product_cd"),
        or_unknown(F.col("card4")).alias("card_network"),
        or_unknown(F.col("card6")).alias("card_type"),
        or_unknown(F.col("P_emaildomain")).alias("email_domain"),
        F.col("addr1").cast("double").alias("addr1"),
        F.col("dist1").cast("double").alias("dist1"),
        F.col("isFraud").cast("int").alias("is_fraud"),
    )


def sample_keys(events: DataFrame, n: int, seed: int = 7, key: str = "card_id") -> DataFrame:
    """All rows of n keys, chosen by a seeded hash that other engines can compute."""
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key)))
    chosen = events.select(key).distinct().orderBy(order, key).limit(n)
    return events.join(chosen, key, "left_semi")


def write_events(events: DataFrame, path: str) -> None:
    events.select(*EVENT_COLUMNS).orderBy("event_timestamp", "transaction_id").write.mode("overwrite").parquet(path)


def load_events(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(EVENT_SCHEMA).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no events at {path}; prepare them first") from error
        raise


def profile(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("card_id").alias("n_cards"),
        F.min("event_timestamp").alias("first_ts"),
        F.max("event_timestamp").alias("last_ts"),
        F.avg("is_fraud").alias("label_rate"),
    )


def to_wire(events: DataFrame) -> DataFrame:
    """Key and compact JSON, nulls kept, times as ISO strings; a column `arrival` is sent along."""
    fields = [F.col("arrival")] if "arrival" in events.columns else []
    # the time stands early in the message, so that messages sort by it
    fields += [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if c == "event_timestamp" else F.col(c) for c in ["event_timestamp", *[c for c in EVENT_COLUMNS if c != "event_timestamp"]]]
    return events.select(F.col("card_id").alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def from_wire(messages: DataFrame, *carry: str) -> DataFrame:
    """Parsed events and a reject reason: malformed JSON, missing key fields, a negative amount, a label outside {0, 1}.

    Unknown fields are ignored; null strings, codes and the label get their defaults."""
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    parsed = messages.select(*carry, "value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select(*carry, "value", "e.*")
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "malformed")
        .when(F.col("transaction_id").isNull() | F.col("card_id").isNull() | F.col("event_timestamp").isNull() | F.col("amount").isNull(), "missing field")
        .when(F.col("amount") < 0, "negative amount")
        .when(~F.coalesce(F.col("is_fraud"), F.lit(0)).isin(0, 1), "bad label")
    )
    filled = {"product_cd": known_product(F.col("product_cd"))} | {c: or_unknown(F.col(c)) for c in ("card_network", "card_type", "email_domain")}
    return parsed.withColumn("reject", reason).withColumns(filled).drop("_corrupt")


def valid(parsed: DataFrame, *carry: str) -> DataFrame:
    return parsed.filter("reject is null").select(*EVENT_COLUMNS, *carry)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject is not null").select("value", "reject")


def land(events: DataFrame, path: str) -> None:
    """Append to the landing folder with the fixed schema."""
    events.select(*[F.col(f.name).cast(f.dataType) for f in EVENT_SCHEMA.fields]).write.mode("append").parquet(path)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """All landed files under one schema; an event that was landed twice counts once."""
    return spark.read.schema(EVENT_SCHEMA).parquet(path).dropDuplicates(["transaction_id"])


def tail(events: DataFrame, n: int) -> DataFrame:
    """The last n rows by (event_timestamp, transaction_id)."""
    return events.orderBy(F.desc("event_timestamp"), F.desc("transaction_id")).limit(n)


def head(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy("event_timestamp", "transaction_id").limit(n)


def synthetic(spark: SparkSession, n_cards: int = 200, n_events: int = 5000, seed: int = 7, duplicate_ts_rate: float = 0.08, shift: str | None = None) -> DataFrame:
    """Events with the documented distributions; every value is an md5 of (seed, name, row), so any partitioning gives the same rows.

    Owners are skewed (weight rank^-0.8).  Gaps of a card are exponential with mean 18,000 s (900 s
    under shift "velocity"), and a share of rows has no gap, so that it ties with the row before.
    Amounts are lognormal (3.4, 1.1) in cents (times 4 under "amount"), products follow
    .70/.12/.08/.06/.04 (all C under "product"), networks and types are uniform, and labels are 0.01,
    and 0.05 likelier above the 97th percentile of the amounts."""
    if shift not in (None, "amount", "velocity", "product"):
        raise ValueError(f"unknown shift {shift!r}")

    def uniform(name: str) -> Column:
        digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(name), F.col("transaction_id").cast("string")))
        return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    rows = spark.range(1, n_events + 1).withColumnRenamed("id", "transaction_id")
    power = 0.2  # the integral of rank^-0.8
    rank = F.least(F.pow(uniform("owner") * (F.pow(F.lit(float(n_cards + 1)), power) - 1) + 1, 1 / power).cast("long"), F.lit(n_cards))
    mean_gap = 900.0 if shift == "velocity" else 18000.0
    gap = F.when(uniform("tie") < duplicate_ts_rate, 0).otherwise(F.floor(-F.log(uniform("gap")) * mean_gap) + 1)
    normal = F.sqrt(-2 * F.log(uniform("r"))) * F.cos(2 * 3.141592653589793 * uniform("phi"))
    p = uniform("product")
    product = F.lit("C") if shift == "product" else F.when(p < 0.7, "W").when(p < 0.82, "C").when(p < 0.9, "R").when(p < 0.96, "H").otherwise("S")
    network, kind = uniform("network"), uniform("type")
    made = rows.select(
        "transaction_id",
        F.format_string("card_%05d", rank).alias("card_id"),
        gap.cast("long").alias("gap"),
        (F.round(F.exp(normal * 1.1 + 3.4), 2) * (4.0 if shift == "amount" else 1.0)).alias("amount"),
        product.alias("product_cd"),
        F.when(network < 1 / 3, "visa").when(network < 2 / 3, "mastercard").otherwise("discover").alias("card_network"),
        F.when(kind < 0.5, "credit").otherwise("debit").alias("card_type"),
        F.lit("example.com").alias("email_domain"),
        F.floor(uniform("addr") * 400 + 100).cast("double").alias("addr1"),
        F.floor(uniform("dist") * 200).cast("double").alias("dist1"),
        uniform("label").alias("label"),
    )
    moment = F.sum("gap").over(Window.partitionBy("card_id").orderBy("transaction_id").rowsBetween(Window.unboundedPreceding, 0))
    large = made.agg(F.percentile_approx("amount", 0.97, 10_000).alias("large"))
    timed = made.withColumn("event_timestamp", F.timestamp_seconds(F.lit(EPOCH) + moment)).crossJoin(F.broadcast(large))  # one row
    return timed.withColumn("is_fraud", (F.col("label") < F.when(F.col("amount") > F.col("large"), 0.06).otherwise(0.01)).cast("int")).select(*EVENT_COLUMNS)


def cached_or_built(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """The table at path, built and written first if it is not there or if asked to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    if rebuild or not target.getFileSystem(conf).exists(target):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Training sets: features of each event, chronological splits, and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.features import calendar, ondemand
from millrace.operators.asof import asof_join_by_size, lost_rows
from millrace.operators.ordered import quantiles
from millrace.operators.windows import require, seconds, tie_rank, trailing_features_by_size
from millrace.sources.events import cached_or_built
from millrace.spec import FEATURE_NAMES, FEATURES, MODEL_INPUTS

TTL_SECONDS = 8 * 86400


def feature_table(events: DataFrame) -> DataFrame:
    """The stored form: card, a timestamp that ties cannot share, created, and the features in the types of the spec."""
    rows = tie_rank(trailing_features_by_size(events))
    typed = [F.col(f.name).cast(f.spark_type).alias(f.name) for f in FEATURES]
    return rows.select("card_id", F.col("unique_timestamp").alias("event_timestamp"), F.col("unique_timestamp").alias("created"), *typed)


def from_store(events: DataFrame, table: DataFrame, ttl_seconds: int | None = TTL_SECONDS) -> DataFrame:
    """Events with the stored features as of their own (untied) time."""
    entities = tie_rank(events).drop("tie_rank")
    return asof_join_by_size(entities, table, "card_id", "unique_timestamp", "event_timestamp", FEATURE_NAMES, "created", ttl_seconds).drop("unique_timestamp")


def training_set(events: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """id, card, time, label and the 31 model inputs of each event.

    A row's features are made where the row is; with a feature table they are joined as of its time."""
    require(events, "transaction_id", "card_id", "event_timestamp", "amount", "product_cd")
    rows = trailing_features_by_size(events) if table is None else from_store(events, table)
    full = rows.withColumns(ondemand() | calendar())
    require(full, *MODEL_INPUTS)
    return full.select("transaction_id", "card_id", "event_timestamp", "is_fraud", *MODEL_INPUTS)


def checked(events: DataFrame, built: DataFrame) -> DataFrame:
    """The training set, if it lost no event; else an error with the number lost."""
    lost = lost_rows(events, built, "transaction_id").count()
    if lost:
        raise ValueError(f"{lost} events have no row in the training set")
    return built


def position(df: DataFrame, place: int, ts: str = "event_timestamp", key: str = "transaction_id") -> tuple[int, int] | None:
    """(seconds, id) of the row at a place (from 0) in the order of time and id; None past the end.

    Counts by day, then by second of the one day that holds the place, find it: what comes to the
    driver is one number a day or a second, never rows."""
    rows = df.select(seconds(ts).alias("u"), F.col(key).alias("k"))

    def step(by, part: DataFrame, left: int):
        for value, n in sorted(tuple(r) for r in part.groupBy(by.alias("b")).agg(F.count(F.lit(1))).collect()):
            if left < n:
                return value, left
            left -= n
        return None, left

    day, left = step(F.floor(F.col("u") / 86400), rows, place)
    if day is None:
        return None
    second, left = step(F.col("u"), rows.filter(F.floor(F.col("u") / 86400) == day), left)
    tied = rows.filter(F.col("u") == second).orderBy("k").limit(left + 1).agg(F.max("k")).first()[0]
    return second, tied


def chronological_split(df: DataFrame, valid_frac: float = 0.15, test_frac: float = 0.15, ts: str = "event_timestamp", key: str = "transaction_id") -> DataFrame:
    """df with `split`: rows before int(n * (1 - valid - test)) in time order train, then valid, then test."""
    n = df.count()
    cuts = [position(df, int(n * share), ts, key) for share in (round(1 - valid_frac - test_frac, 10), round(1 - test_frac, 10))]

    def before(cut):
        if cut is None:
            return F.lit(True)
        return (seconds(ts) < cut[0]) | ((seconds(ts) == cut[0]) & (F.col(key) < cut[1]))

    return df.withColumn("split", F.when(before(cuts[0]), "train").when(before(cuts[1]), "valid").otherwise("test"))


def split_profile(split: DataFrame, label: str = "is_fraud") -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(label).alias("label_rate"), F.min("event_timestamp").alias("first_ts"), F.max("event_timestamp").alias("last_ts"))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_values, is_constant); null is a value of its own."""
    stats = df.agg(*[(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long").alias(c) for c in columns])
    long = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("n_values")) for c in columns])).alias("x")).select("x.*")
    return long.withColumn("is_constant", F.col("n_values") <= 1)


def no_dead_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if none of the columns is constant; else an error that names those that are.

    Least and largest values and a count of nulls tell, so that no distinct values move."""
    stats = [F.struct(F.min(c).eqNullSafe(F.max(c)).alias("one"), F.count(c).alias("n")).alias(c) for c in columns]
    found = df.agg(*stats, F.count(F.lit(1)).alias("_rows")).first()
    dead = sorted(c for c in columns if found[c]["one"] and found[c]["n"] in (0, found["_rows"]))
    if dead:
        raise ValueError(f"constant columns: {dead}")
    return df


def write_training_set(events: DataFrame, path: str, table: DataFrame | None = None, rebuild: bool = False) -> DataFrame:
    """The checked training set at path, built and written if it is not there or if asked to."""
    return cached_or_built(events.sparkSession, path, lambda: checked(events, training_set(events, table)), rebuild)


def class_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Negatives over positives."""
    positive = F.count(F.when(F.col(label) == 1, 1))
    return df.agg(F.count(F.when(F.col(label) == 0, 1)).alias("negatives"), positive.alias("positives"), (F.count(F.when(F.col(label) == 0, 1)) / F.greatest(positive, F.lit(1))).alias("weight"))


def label_csv(df: DataFrame, columns: list[str], label: str = "is_fraud") -> DataFrame:
    """The label first, for writers of headerless files."""
    return df.select(label, *columns)


def median_gap(events: DataFrame, entity: str = "card_id", ts: str = "event_timestamp", key: str = "transaction_id") -> DataFrame:
    gap = seconds(ts) - F.lag(seconds(ts)).over(Window.partitionBy(entity).orderBy(seconds(ts), key))
    found = quantiles(events.select(gap.alias("gap")), "gap", [0.5])
    return events.sparkSession.createDataFrame([tuple(found)], "median_gap double")

"""The feature contract: names, types, windows and defaults, declared once.

A window feature of length W for an event at t covers the same card's events with a timestamp in
the open interval (t - W, t): never the event itself, never one tied with it, and not one exactly
W seconds old.  Empty history gives the default, never null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values of the contract.
WINDOWS = {"1h": 3600, "24h": 86400, "7d": 604800}
PRODUCTS = ("W", "C", "R", "H", "S")
FALLBACK_PRODUCT = "W"
NO_LAST = -1.0
NO_GAP = -1.0
RATIO_EPSILON = 1e-6
RATIO_CAP = 1000.0
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Feature:
    name: str
    dtype: str
    default: float
    about: str

    @property
    def spark_type(self) -> T.DataType:
        return T.LongType() if self.dtype == "int64" else T.DoubleType()


def _features() -> tuple[Feature, ...]:
    out = []
    for kind, dtype, default, about in (
        ("txn_count", "int64", 0, "events in the window"),
        ("amt_sum", "float64", 0.0, "sum of amounts in the window"),
        ("amt_mean", "float64", 0.0, "mean amount in the window"),
        ("amt_max", "float64", 0.0, "largest amount in the window"),
    ):
        out += [Feature(f"{kind}_{w}", dtype, default, f"{about} ({w})") for w in WINDOWS]
    out += [
        Feature("last_txn_unixtime", "float64", NO_LAST, "time of the latest earlier event"),
        Feature("txn_count_lifetime", "int64", 0, "all earlier events"),
    ]
    return tuple(out + [Feature(f"product_{p}_count_7d", "int64", 0, f"events of product {p} in 7d") for p in PRODUCTS])


FEATURES = _features()
FEATURE_NAMES = [f.name for f in FEATURES]
DEFAULTS = {f.name: f.default for f in FEATURES}

# Names of request-time features, model inputs and watched columns.
ONDEMAND = ["amt_over_mean_24h", "amt_over_max_7d", "product_freq_7d", "seconds_since_last_txn"]
REQUEST = ["amount", "hour_of_day", "day_of_week", "addr1", "dist1"]
STORE_ONLY = {"last_txn_unixtime"}  # an absolute time cannot carry over a chronological split
MODEL_STORED = [n for n in FEATURE_NAMES if n not in STORE_ONLY]
NUMERIC = REQUEST + MODEL_STORED + ONDEMAND
CATEGORICAL = ["product_cd", "card_network", "card_type", "email_domain"]
MODEL_INPUTS = NUMERIC + CATEGORICAL
MONITORED = [*MODEL_STORED, *ONDEMAND, "amount"]
KEY_FEATURES = ["amount", "amt_mean_24h", "amt_over_mean_24h", "txn_count_1h", "seconds_since_last_txn", "product_freq_7d"]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.LongType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("event_timestamp", T.TimestampType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("product_cd", T.StringType()),
        T.StructField("card_network", T.StringType()),
        T.StructField("card_type", T.StringType()),
        T.StructField("email_domain", T.StringType()),
        T.StructField("addr1", T.DoubleType()),
        T.StructField("dist1", T.DoubleType()),
        T.StructField("is_fraud", T.IntegerType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.names

"""Declared schemas: event envelope, full event superset, feature contract."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import types as T

# The event types a shop emits.
EVENT_TYPES = (
    "pageview",
    "search",
    "add_to_cart",
    "payment",
    "user_signup",
    "product_view",
    "checkout",
    "click",
)

# Agents that count as anomalies, and all known agents.
ANOMALOUS_AGENTS = ("bot", "fraud")
AGENT_TYPES = ("normal", "bot", "fraud", "churning")

# Topic name and defaults of omitted event fields.
TOPIC = "shop-events"
DEFAULT_URL = "https://example.com"
DEFAULT_QUANTITY = 1
DEFAULT_SIGNUP_METHOD = "email"

_S, _D, _I, _L, _TS = (
    T.StringType(),
    T.DoubleType(),
    T.IntegerType(),
    T.LongType(),
    T.TimestampType(),
)

# What the live job reads from each message; other JSON keys are dropped.
ENVELOPE = T.StructType(
    [
        T.StructField("event_id", _S),
        T.StructField("event_type", _S),
        T.StructField("timestamp", _TS),
        T.StructField("session_id", _S),
        T.StructField("user_id", _S),
        T.StructField("url", _S),
        T.StructField("product_id", _S),
        T.StructField("status", _S),
        T.StructField(
            "properties",
            T.StructType([T.StructField("ip", _S), T.StructField("agent_type", _S)]),
        ),
    ]
)

# Every field any event type may carry. ``properties`` stays an open map here.
FULL_EVENT = T.StructType(
    [f for f in ENVELOPE.fields if f.name != "properties"]
    + [
        T.StructField("properties", T.MapType(_S, _S)),
        T.StructField("referrer", _S),
        T.StructField("query", _S),
        T.StructField("quantity", _I),
        T.StructField("cart_total", _D),
        T.StructField("item_count", _I),
        T.StructField("amount", _D),
        T.StructField("payment_method", _S),
        T.StructField("email", _S),
        T.StructField("method", _S),
        T.StructField("element_id", _S),
        T.StructField("target_url", _S),
        T.StructField("category", _S),
        T.StructField("price", _D),
    ]
)

CORRUPT = "_corrupt_record"

# Envelope fields that must be present.
REQUIRED_ENVELOPE = ("event_type", "session_id", "user_id")

# Fields of each event type, those that must be present, those that may be absent.
REQUIRED_FIELDS = {
    "pageview": (),
    "search": ("query",),
    "add_to_cart": ("product_id",),
    "checkout": ("cart_total", "item_count"),
    "payment": ("amount", "status", "payment_method"),
    "user_signup": ("email",),
    "click": ("element_id",),
    "product_view": ("product_id",),
}
OPTIONAL_FIELDS = {
    "pageview": ("url", "referrer"),
    "search": (),
    "add_to_cart": ("quantity",),
    "checkout": (),
    "payment": (),
    "user_signup": ("method",),
    "click": ("target_url",),
    "product_view": ("category", "price"),
}


@dataclass(frozen=True)
class FeatureView:
    """A named set of typed feature columns with its key, clock and expiry."""

    name: str
    key: str
    event_time: str
    ttl: timedelta
    fields: dict[str, T.DataType] = field(hash=False)

    @property
    def features(self) -> list[str]:
        return list(self.fields)


# Name, columns, types and expiry of the feature contract.
SESSION_FEATURES = FeatureView(
    name="session_features",
    key="session_id",
    event_time="event_timestamp",
    ttl=timedelta(hours=1),
    fields={
        "events_per_minute": _D,
        "unique_pages_visited": _D,
        "avg_time_between_events": _D,
        "cart_to_purchase_ratio": _D,
        "session_duration_seconds": _D,
        "event_type_diversity": _L,
        "has_payment": _L,
        "signup_to_purchase_speed": _D,
        "page_revisit_ratio": _D,
    },
)

FEATURE_COLUMNS = SESSION_FEATURES.features

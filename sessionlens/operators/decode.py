"""Messages to typed rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.functions.expressions import computed_once, kv_key
from sessionlens.schema import CORRUPT, DEFAULT_QUANTITY, DEFAULT_SIGNUP_METHOD, DEFAULT_URL, ENVELOPE, FULL_EVENT

# ISO-8601 with microseconds, so that a round trip loses nothing.
_JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def drop_tombstones(messages: DataFrame) -> DataFrame:
    """Messages that carry a value."""
    return messages.where(F.col("value").isNotNull())


def decode_events(
    messages: DataFrame, schema: T.StructType = ENVELOPE, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Message bytes to flat typed columns; unreadable fields become null."""
    text = F.col("value").cast("string")
    return messages.select(*keep, computed_once(F.from_json(text, schema)))


def decode_checked(
    messages: DataFrame, schema: T.StructType = FULL_EVENT, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Like ``decode_events`` but keeps the text of messages that did not parse.

    Tombstones are skipped. ``_corrupt_record`` is null for a clean message.
    """
    watched = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    text = F.col("value").cast("string")
    parsed = F.from_json(text, watched, {"columnNameOfCorruptRecord": CORRUPT})
    return drop_tombstones(messages).select(*keep, computed_once(parsed))


def corrupt_events(
    messages: DataFrame, schema: T.StructType = FULL_EVENT, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Messages whose value is not JSON or holds a value of the wrong type."""
    checked = decode_checked(messages, schema, keep)
    return checked.where(F.col(CORRUPT).isNotNull()).select(
        *keep, F.col(CORRUPT).alias("raw_value")
    )


def flatten_properties(events: DataFrame) -> DataFrame:
    """Envelope with ``properties`` opened into ``ip`` and ``agent_type``."""
    flat = [c for c in events.columns if c != "properties"]
    return events.select(*flat, "properties.ip", "properties.agent_type")


def event_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), _JSON_OPTIONS)


def publish_events(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Topic messages: the user as key, the event as JSON value.

    The topic keeps the messages of one key in order, so one user stays ordered.
    """
    columns = columns or events.columns
    return events.select(F.col("user_id").alias("key"), event_json(columns).alias("value"))


def event_roundtrip(events: DataFrame, schema: T.StructType = FULL_EVENT) -> DataFrame:
    """Rows before and after a trip through JSON, one row per event with a verdict.

    Both sides sit in the same row, so checking needs no shuffle. Map properties
    are compared through their sorted entries.
    """
    columns = [f.name for f in schema.fields if f.name in events.columns]
    typed = T.StructType([f for f in schema.fields if f.name in columns])
    before = events.select(*columns)
    both = before.withColumn("_back", F.from_json(event_json(columns), typed))

    def comparable(column: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.MapType):
            return F.sort_array(F.map_entries(column))
        return column

    same = F.lit(True)
    for f in typed.fields:
        left = comparable(F.col(f.name), f.dataType)
        right = comparable(F.col(f"_back.{f.name}"), f.dataType)
        same = same & left.eqNullSafe(right)
    return both.select("event_id", same.alias("intact"))


def features_to_kv_json(features: DataFrame, columns: list[str]) -> DataFrame:
    """Key-value pairs of the online store: ``session:<id>`` to a JSON object."""
    return features.select(
        kv_key(F.col("session_id")).alias("key"),
        F.to_json(F.struct(*columns)).alias("value"),
    )


def apply_event_defaults(events: DataFrame, generate: bool = True) -> DataFrame:
    """Fill the omitted fields that have defaults, each for its own event type.

    ``generate`` also fills event ids (random) and timestamps (now).
    """
    def default(column: str, event_type: str, value: object) -> Column:
        absent = F.col(column).isNull() & (F.col("event_type") == event_type)
        return F.when(absent, F.lit(value)).otherwise(F.col(column))

    fills = {
        "url": default("url", "pageview", DEFAULT_URL),
        "quantity": default("quantity", "add_to_cart", DEFAULT_QUANTITY),
        "method": default("method", "user_signup", DEFAULT_SIGNUP_METHOD),
    }
    if "properties" in events.columns:
        kind = events.schema["properties"].dataType
        if isinstance(kind, T.MapType):
            empty = F.create_map().cast(kind)
            fills["properties"] = F.coalesce(F.col("properties"), empty)
    if generate:
        fills["event_id"] = F.coalesce(F.col("event_id"), F.uuid())
        fills["timestamp"] = F.coalesce(F.col("timestamp"), F.current_timestamp())
    return events.withColumns({c: e for c, e in fills.items() if c in events.columns})


def tap_pageviews(events: DataFrame) -> DataFrame:
    """Page views only: type, user and url."""
    return events.where(F.col("event_type") == "pageview").select(
        "event_type", "user_id", "url"
    )

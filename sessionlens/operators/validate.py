"""Typed validation, dispatch by event type, quarantine and duplicate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.schema import (
    CORRUPT,
    EVENT_TYPES,
    OPTIONAL_FIELDS,
    REQUIRED_ENVELOPE,
    REQUIRED_FIELDS,
)


def _error_list(columns: list[str]) -> Column:
    rules: list[tuple[Column, str]] = []
    if CORRUPT in columns:
        rules.append((F.col(CORRUPT).isNotNull(), "malformed"))
    rules += [(F.col(c).isNull(), f"missing {c}") for c in REQUIRED_ENVELOPE]
    rules.append((~F.col("event_type").isin(*EVENT_TYPES), "unknown event_type"))
    for event_type, required in REQUIRED_FIELDS.items():
        of_type = F.col("event_type") == event_type
        rules += [(of_type & F.col(c).isNull(), f"missing {c}") for c in required]
    found = F.array(*[F.when(bad, F.lit(message)) for bad, message in rules])
    return F.array_compact(found)


def validate_events(events: DataFrame) -> DataFrame:
    """Add ``errors``: every rule an event breaks, empty for a valid event."""
    return events.withColumn("errors", _error_list(events.columns))


def valid_events(events: DataFrame) -> DataFrame:
    checked = validate_events(events).where(F.size("errors") == 0)
    return checked.drop("errors", CORRUPT)


def quarantine_events(events: DataFrame) -> DataFrame:
    """Events that break a rule, with the reasons; the rest of the row is kept."""
    return validate_events(events).where(F.size("errors") > 0)


def dispatch_by_type(events: DataFrame) -> DataFrame:
    """One struct column per event type, filled only for that type.

    ``route`` is the event type, or ``quarantine`` for an unknown or absent one.
    """
    known = F.col("event_type").isin(*EVENT_TYPES)
    route = F.when(known, F.col("event_type")).otherwise(F.lit("quarantine"))
    shared = [
        c
        for c in ("event_id", "timestamp", "session_id", "user_id", "properties")
        if c in events.columns
    ]
    structs = []
    for event_type in EVENT_TYPES:
        own = REQUIRED_FIELDS[event_type] + OPTIONAL_FIELDS[event_type]
        present = [c for c in own if c in events.columns]
        body = F.struct(*present) if present else F.struct(F.lit(True).alias("present"))
        structs.append(F.when(F.col("event_type") == event_type, body).alias(event_type))
    return events.select(*shared, route.alias("route"), *structs)


def duplicate_event_ids(events: DataFrame) -> DataFrame:
    """Event ids that occur more than once."""
    counted = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))
    return counted.where(F.col("copies") > 1)

"""Live session features: one streaming aggregate and formulas on top of it.

These differ from the exact features on purpose: distinct counts are approximate,
times are cut to whole seconds, payments count whatever their status, and small
constants stand in for divide-by-zero guards. The same code runs on a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.expressions import (
    is_pageview,
    is_success_payment,
    is_type,
    whole_seconds,
)

# The constant added by the formulas, and the watermark delay.
EPSILON = 0.001
WATERMARK = "1 minute"

AGGREGATE_COLUMNS = (
    "event_count",
    "unique_pages_visited",
    "event_type_diversity",
    "session_start",
    "session_end",
    "payment_count",
    "cart_count",
    "signup_time",
    "purchase_time",
    "pageview_count",
    "agent_type",
)


def live_aggregate(events: DataFrame) -> DataFrame:
    """The eleven running aggregates of each session."""
    agent = (
        F.col("agent_type") if "agent_type" in events.columns
        else F.col("properties.agent_type")
    )
    at = F.col("timestamp")
    return events.groupBy("session_id").agg(
        F.count("event_id").alias("event_count"),
        F.approx_count_distinct("url").alias("unique_pages_visited"),
        F.approx_count_distinct("event_type").alias("event_type_diversity"),
        F.min(at).alias("session_start"),
        F.max(at).alias("session_end"),
        F.count_if(is_type("payment")).alias("payment_count"),
        F.count_if(is_type("add_to_cart")).alias("cart_count"),
        F.min(F.when(is_type("user_signup"), at)).alias("signup_time"),
        F.min(F.when(is_success_payment(), at)).alias("purchase_time"),
        F.count_if(is_pageview()).alias("pageview_count"),
        F.min(agent).alias("agent_type"),
    )


def live_features(aggregated: DataFrame) -> DataFrame:
    """The derived columns, added to the aggregates.

    A session without cart events has no ratio (null), and the constant is added
    to the finished quotient.
    """
    duration = whole_seconds(F.col("session_start"), F.col("session_end"))
    speed = whole_seconds(F.col("signup_time"), F.col("purchase_time"))
    seen = F.col("unique_pages_visited") / F.nullif(F.col("pageview_count"), F.lit(0))
    return aggregated.select(
        "session_id",
        *AGGREGATE_COLUMNS,
        duration.alias("session_duration_seconds"),
        (F.col("event_count") / ((duration + EPSILON) / 60)).alias("events_per_minute"),
        (duration / (F.col("event_count") - 1 + EPSILON)).alias(
            "avg_time_between_events"
        ),
        (F.try_divide(F.col("payment_count"), F.col("cart_count")) + EPSILON).alias(
            "cart_to_purchase_ratio"
        ),
        (F.col("payment_count") > 0).cast("int").alias("has_payment"),
        F.coalesce(speed.cast("double"), F.lit(0.0)).alias("signup_to_purchase_speed"),
        F.col("session_end").alias("event_timestamp"),
        F.coalesce(1 - seen, F.lit(0.0)).alias("page_revisit_ratio"),
    )


def live_session_features(events: DataFrame) -> DataFrame:
    """Batch twin of the live job: what a session's row is once all events are in."""
    return live_features(live_aggregate(events))

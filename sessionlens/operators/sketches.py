"""Live aggregates as mergeable states: counts add up, distinct counts are kept as sketches.

A state has one row per key, whatever number of events it stands for. States of waves, days,
late batches or other sites merge into the state of all their events in any order, so a
running job needs no state of its own, a late batch is one more state, and a coarser key is
served from the states of a finer one. Sketches ignore repeats, counts do not: every event
belongs into one state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.expressions import is_pageview, is_success_payment, is_type
from sessionlens.operators.live import AGGREGATE_COLUMNS, live_features

#: Registers of a sketch are 2 to this power: at 12 about 2.5 KB and 1.6 % standard error,
#: and small counts are kept as lists of a few bytes.
SKETCH_LOG_SIZE = 12

#: Distinct counts and the columns that hold their sketches.
SKETCHES = {"unique_pages_visited": "pages_sketch", "event_type_diversity": "types_sketch"}
_ADDED = ("event_count", "payment_count", "cart_count", "pageview_count")
_LEAST = ("session_start", "signup_time", "purchase_time", "agent_type")
_GREATEST = ("session_end",)


def event_states(
    events: DataFrame, keys: Sequence[str] = ("session_id",), log_size: int = SKETCH_LOG_SIZE
) -> DataFrame:
    """The state of each key. Null urls and types count for nothing; a null key is a key."""
    at = F.col("timestamp")
    agent = (
        F.col("agent_type") if "agent_type" in events.columns else F.col("properties.agent_type")
    )
    return events.groupBy(*keys).agg(
        F.count("event_id").alias("event_count"),
        F.hll_sketch_agg("url", F.lit(log_size)).alias("pages_sketch"),
        F.hll_sketch_agg("event_type", F.lit(log_size)).alias("types_sketch"),
        F.min(at).alias("session_start"),
        F.max(at).alias("session_end"),
        F.count_if(is_type("payment")).alias("payment_count"),
        F.count_if(is_type("add_to_cart")).alias("cart_count"),
        F.min(F.when(is_type("user_signup"), at)).alias("signup_time"),
        F.min(F.when(is_success_payment(), at)).alias("purchase_time"),
        F.count_if(is_pageview()).alias("pageview_count"),
        F.min(agent).alias("agent_type"),
    )


def merge_states(states: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """One state per key; ``keys`` may be fewer than those the states were made for."""
    return states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _ADDED],
        *[F.hll_union_agg(c).alias(c) for c in SKETCHES.values()],
        *[F.min(c).alias(c) for c in _LEAST],
        *[F.max(c).alias(c) for c in _GREATEST],
    )


def state_aggregates(states: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The eleven live aggregates of each key from its states, distinct counts estimated.

    A sketch filled in one pass is estimated from the order of its updates, a union from its
    registers. Every sketch is therefore joined with itself, which changes no register: the
    estimate then depends on the events alone, not on how they were dealt into states.
    """
    merged = merge_states(states, keys)
    for name, sketch in SKETCHES.items():
        merged = merged.withColumn(name, F.hll_sketch_estimate(F.hll_union(sketch, sketch)))
    return merged.select(*keys, *AGGREGATE_COLUMNS)


def sketch_features(states: DataFrame) -> DataFrame:
    """Live features per session from states of any waves."""
    return live_features(state_aggregates(states))

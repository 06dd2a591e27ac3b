"""Behaviour checks over event tables: session shape, funnel, rings, decay, pace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.expressions import ip_subnet, is_exit, is_success_payment, is_type
from sessionlens.operators.ordered import SLOT_SECONDS
from sessionlens.operators.sessions import event_gaps

# Allowed seconds between events, per kind of agent.
HUMAN_GAP = (5.0, 30.0)
BOT_GAP = (0.5, 1.2)
MAX_SESSION_EVENTS = 1000


def session_shape(events: DataFrame, max_events: int = MAX_SESSION_EVENTS) -> DataFrame:
    """Does a session start at a landing page or signup, end with exit, stay short?"""
    order = F.struct("timestamp", "event_id")
    facts = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("event_type", order).alias("first_event_type"),
        F.max_by(is_exit(), order).alias("ended_with_exit"),
    )
    return facts.select(
        "session_id",
        "event_count",
        (F.col("event_count") < max_events).alias("length_ok"),
        F.col("first_event_type").isin("pageview", "user_signup").alias("landing_ok"),
        "ended_with_exit",
    )


def funnel_order(events: DataFrame) -> DataFrame:
    """For sessions that paid: did the first checkout come before the first payment?"""
    first = events.groupBy("session_id").agg(
        F.min(F.when(is_type("checkout"), F.col("timestamp"))).alias("first_checkout"),
        F.min(F.when(is_type("payment"), F.col("timestamp"))).alias("first_payment"),
    )
    return first.where(F.col("first_payment").isNotNull()).withColumn(
        "in_order",
        F.coalesce(F.col("first_checkout") < F.col("first_payment"), F.lit(False)),
    )


def subnet_activity(events: DataFrame, by_product: bool = False) -> DataFrame:
    """Sessions, addresses and successful payments per /24 subnet (and product).

    Each distinct count has its own pre-grouping, which combines map-side, instead
    of one row copy per count; the two small results join on the group.
    """
    keys = ["subnet"] + (["product_id"] if by_product else [])
    located = events.withColumn("subnet", ip_subnet(F.col("ip")))
    if by_product:
        located = located.where(F.col("product_id").isNotNull())
    wins = F.count_if(is_success_payment()).alias("wins")
    session_side = (
        located.groupBy(*keys, "session_id")
        .agg(wins)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.sum("wins").alias("successful_payments"),
        )
    )
    address_side = (
        located.select(*keys, "ip")
        .distinct()
        .groupBy(*keys)
        .agg(F.count("ip").alias("addresses"))
    )
    return session_side.join(address_side, keys)


def ring_candidates(
    events: DataFrame, min_sessions: int = 2, by_product: bool = False
) -> DataFrame:
    """Subnets (optionally with a target product) many sessions of several ips share."""
    active = subnet_activity(events, by_product).drop("successful_payments")
    return active.where(
        (F.col("sessions") >= min_sessions) & (F.col("addresses") > 1)
    )


def ring_conversion(events: DataFrame, min_sessions: int = 2) -> DataFrame:
    """Successful payments of each ring candidate against its number of sessions."""
    active = subnet_activity(events).where(
        (F.col("sessions") >= min_sessions) & (F.col("addresses") > 1)
    )
    return active.select(
        "subnet",
        "sessions",
        "successful_payments",
        (F.col("successful_payments") == F.col("sessions")).alias("full_conversion"),
    )


def engagement_decay(events: DataFrame) -> DataFrame:
    """Per user: more than one session, the last no busier than the first, time moves on."""
    sessions = events.groupBy("user_id", "session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("opened"),
        F.max("timestamp").alias("closed"),
    )
    order = F.struct("opened", "session_id")
    users = sessions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.min_by("n", order).alias("first_events"),
        F.max_by("n", order).alias("last_events"),
        F.min("opened").alias("_from"),
        F.max("closed").alias("_to"),
    )
    return users.select(
        "user_id",
        "sessions",
        "first_events",
        "last_events",
        (
            (F.col("sessions") > 1)
            & (F.col("last_events") <= F.col("first_events"))
            & (F.col("_to") > F.col("_from"))
        ).alias("decays"),
    )


def gap_bounds(
    events: DataFrame,
    human: tuple[float, float] = HUMAN_GAP,
    bot: tuple[float, float] = BOT_GAP,
    chunk_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """Gaps per agent type and how many fall outside that agent's pace."""
    gaps = event_gaps(events, chunk_seconds).where(F.col("gap_seconds").isNotNull())
    gap = F.col("gap_seconds")
    outside = F.when(F.col("agent_type") == "bot", ~gap.between(*bot)).otherwise(
        ~gap.between(*human)
    )
    return gaps.groupBy("agent_type").agg(
        F.count(F.lit(1)).alias("gaps"), F.count_if(outside).alias("outside")
    )

"""Exact session features: the canonical definitions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.expressions import exact_seconds
from sessionlens.operators.aggregates import event_type_diversity, session_profile
from sessionlens.schema import FEATURE_COLUMNS

_BOUNDS = ("rows", "session_start", "session_end")

# The session measures each feature is computed from.
NEEDS = {
    "events_per_minute": _BOUNDS,
    "unique_pages_visited": ("unique_pages",),
    "avg_time_between_events": _BOUNDS,
    "cart_to_purchase_ratio": ("success_count", "cart_count"),
    "session_duration_seconds": _BOUNDS,
    "event_type_diversity": ("type_bits",),
    "has_payment": ("success_count",),
    "signup_to_purchase_speed": ("last_signup", "last_purchase"),
    "page_revisit_ratio": ("unique_urls", "pageview_count"),
}


def _duration() -> Column:
    return exact_seconds(F.col("session_start"), F.col("session_end"))


def _events_per_minute() -> Column:
    n = F.col("rows")
    return (
        F.when(n < 2, F.lit(0.0))
        .when(_duration() <= 0, n.cast("double"))
        .otherwise(F.try_divide(n, _duration()) * 60)
    )


def _avg_gap() -> Column:
    return F.when(F.col("rows") < 2, F.lit(0.0)).otherwise(
        F.try_divide(_duration(), F.col("rows") - 1)
    )


def _cart_ratio() -> Column:
    return F.coalesce(
        F.try_divide(F.col("success_count"), F.col("cart_count")), F.lit(0.0)
    )


def _signup_speed() -> Column:
    return F.coalesce(
        exact_seconds(F.col("last_signup"), F.col("last_purchase")), F.lit(0.0)
    )


def _revisit() -> Column:
    seen = F.try_divide(F.col("unique_urls"), F.col("pageview_count"))
    return F.coalesce(F.lit(1.0) - seen, F.lit(0.0))


FORMULAS = {
    "events_per_minute": _events_per_minute,
    "unique_pages_visited": lambda: F.col("unique_pages").cast("double"),
    "avg_time_between_events": _avg_gap,
    "cart_to_purchase_ratio": _cart_ratio,
    "session_duration_seconds": lambda: F.when(
        F.col("rows") < 2, F.lit(0.0)
    ).otherwise(_duration()),
    "event_type_diversity": event_type_diversity,
    "has_payment": lambda: (F.col("success_count") > 0).cast("long"),
    "signup_to_purchase_speed": _signup_speed,
    "page_revisit_ratio": _revisit,
}


def session_features(
    events: DataFrame,
    features: Iterable[str] = FEATURE_COLUMNS,
    keys: Iterable[str] = ("session_id",),
    arrival: str | None = None,
    keep: Iterable[str] = (),
) -> DataFrame:
    """The chosen exact features per session, plus the ``keep`` measures.

    Only the aggregates the chosen features need are planned; without a page
    feature the whole job is one grouping by session.
    """
    keys, features, keep = list(keys), list(features), list(keep)
    wanted = [n for f in features for n in NEEDS[f]] + keep
    profile = session_profile(events, wanted, keys, arrival)
    return profile.select(
        *keys, *keep, *[FORMULAS[f]().alias(f) for f in features]
    )


def feature_rows(events: DataFrame, arrival: str | None = None) -> DataFrame:
    """Exact features in the shape of the feature view: key, clock, agent, values."""
    kept = session_features(
        events, arrival=arrival, keep=("session_end", "agent_type")
    )
    return kept.withColumnRenamed("session_end", "event_timestamp")


def buffer_features(events: DataFrame, keys: Iterable[str] = ("session_id",)) -> DataFrame:
    """The five values a closed session buffer stores, under their short names."""
    f = session_features(
        events,
        (
            "events_per_minute",
            "unique_pages_visited",
            "avg_time_between_events",
            "cart_to_purchase_ratio",
        ),
        keys,
        keep=("rows",),
    )
    return f.select(
        *keys,
        "events_per_minute",
        F.col("unique_pages_visited").alias("unique_pages"),
        F.col("avg_time_between_events").alias("avg_gap"),
        F.col("cart_to_purchase_ratio").alias("cart_ratio"),
        F.col("rows").alias("event_count"),
    )


def feature_drift(exact: DataFrame, live: DataFrame) -> DataFrame:
    """Live minus exact value of every feature, per session."""
    e, l = exact.alias("e"), live.alias("l")
    return e.join(l, "session_id").select(
        "session_id",
        *[
            (F.col(f"l.{f}") - F.col(f"e.{f}")).alias(f"{f}_drift")
            for f in FEATURE_COLUMNS
        ],
    )

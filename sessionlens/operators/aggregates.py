"""Per-session aggregates.

Counts, bounds and conditional minima combine map-side, so a hot session costs
one partial row per task. Exact distinct pages go through one pre-grouping by
(session, page) that serves both distinct counts at once, instead of one row copy
per distinct aggregate; event types use a bit mask and need no distinct at all.
Buffers are fixed-width numbers, which Spark keeps in a hash aggregate; only the
agent label (a string minimum) makes it sort, so ask for it only where needed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.expressions import (
    is_pageview,
    is_success_payment,
    is_type,
    page_key,
    type_bit,
)


def _when_time(condition: Column) -> Column:
    return F.when(condition, F.col("timestamp"))


def _total(name: str) -> Column:
    return F.sum(name)


def _least(name: str) -> Column:
    return F.min(name)


def _greatest(name: str) -> Column:
    return F.max(name)


@dataclass(frozen=True)
class Measure:
    """An aggregate, and how two partial values of it combine."""

    value: object  # () -> Column over events
    merge: object  # (name) -> Column over partial values


MEASURES: dict[str, Measure] = {
    "rows": Measure(lambda: F.count(F.lit(1)), _total),
    "event_count": Measure(lambda: F.count("event_id"), _total),
    "session_start": Measure(lambda: F.min("timestamp"), _least),
    "session_end": Measure(lambda: F.max("timestamp"), _greatest),
    "payment_count": Measure(lambda: F.count_if(is_type("payment")), _total),
    "success_count": Measure(lambda: F.count_if(is_success_payment()), _total),
    "cart_count": Measure(lambda: F.count_if(is_type("add_to_cart")), _total),
    "pageview_count": Measure(lambda: F.count_if(is_pageview()), _total),
    "signup_time": Measure(lambda: F.min(_when_time(is_type("user_signup"))), _least),
    "purchase_time": Measure(lambda: F.min(_when_time(is_success_payment())), _least),
    "type_bits": Measure(
        lambda: F.bit_or(type_bit()), lambda name: F.bit_or(name)
    ),
}

PAGE_MEASURES = ("unique_pages", "unique_urls")


def _last_seen(arrival: str | None) -> dict[str, Measure]:
    """Time of the signup / successful payment that arrived last in the session."""
    out = {}
    for name, condition in (
        ("last_signup", is_type("user_signup")),
        ("last_purchase", is_success_payment()),
    ):
        if arrival is None:
            out[name] = Measure(
                lambda c=condition: F.max(_when_time(c)), _greatest
            )
            continue
        seq = f"{name}_seq"
        out[seq] = Measure(
            lambda c=condition: F.max(F.when(c, F.col(arrival))), _greatest
        )
        out[name] = Measure(
            lambda c=condition: F.max_by("timestamp", F.when(c, F.col(arrival))),
            lambda n, s=seq: F.max_by(n, s),
        )
    return out


def session_profile(
    events: DataFrame,
    wanted: Iterable[str],
    keys: Iterable[str] = ("session_id",),
    arrival: str | None = None,
) -> DataFrame:
    """The ``wanted`` measures of each session.

    ``arrival`` names a long column that grows in arrival order (such as the topic
    offset); without it events arrive in timestamp order.
    """
    keys, wanted = list(keys), list(dict.fromkeys(wanted))
    catalogue = {**MEASURES, **_last_seen(arrival)}
    simple = [w for w in wanted if w in catalogue]
    for name in list(simple):
        if f"{name}_seq" in catalogue and f"{name}_seq" not in simple:
            simple.append(f"{name}_seq")
    pages = [w for w in wanted if w in PAGE_MEASURES]
    agent = "agent_type" in wanted
    unknown = set(wanted) - set(simple) - set(pages) - {"agent_type"}
    if unknown:
        raise ValueError(f"unknown measures: {sorted(unknown)}")

    values = [catalogue[n].value().alias(n) for n in simple]
    if agent:
        values.append(F.min("agent_type").alias("agent_type"))
    if not pages:
        return events.groupBy(*keys).agg(*values).select(*keys, *wanted)

    values.append(F.max(is_pageview().cast("int")).alias("_as_url"))
    by_page = events.withColumn("_page", page_key()).groupBy(*keys, "_page").agg(*values)
    final = [catalogue[n].merge(n).alias(n) for n in simple]
    if agent:
        final.append(F.min("agent_type").alias("agent_type"))
    return (
        by_page.groupBy(*keys)
        .agg(
            *final,
            F.count("_page").alias("unique_pages"),
            F.count_if(F.col("_page").isNotNull() & (F.col("_as_url") == 1)).alias(
                "unique_urls"
            ),
        )
        .select(*keys, *wanted)
    )


def event_type_diversity() -> Column:
    """Distinct event types from the bit mask of a profile."""
    return F.bit_count("type_bits").cast("long")


def approx_unique_pages(events: DataFrame) -> DataFrame:
    """Approximate distinct urls of a session, whatever event carries them."""
    return events.groupBy("session_id").agg(
        F.approx_count_distinct("url").alias("unique_pages_visited")
    )


def approx_type_diversity(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(
        F.approx_count_distinct("event_type").alias("event_type_diversity")
    )


def mean_gap(events: DataFrame) -> DataFrame:
    """Mean seconds between consecutive events; null for one-event sessions.

    The gaps of a sorted session add up to last minus first, so no sort is needed.
    """
    profile = session_profile(events, ("rows", "session_start", "session_end"))
    span = (F.unix_micros("session_end") - F.unix_micros("session_start")) / F.lit(1e6)
    return profile.select(
        "session_id", F.try_divide(span, F.col("rows") - 1).alias("mean_gap_seconds")
    )


def row_mse(df: DataFrame, left: str, right: str, into: str = "error") -> DataFrame:
    """Mean squared difference of two equally long array columns, per row."""
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumn(into, F.try_divide(total, F.size(left)))

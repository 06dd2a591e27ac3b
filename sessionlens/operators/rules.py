"""Rule bands: which of a session's features look suspicious."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# The limits of the bands.
@dataclass(frozen=True)
class Bands:
    """Limits of the rule bands; the last three put numbers to vague wording."""

    likely_bot_epm: float = 50.0
    definite_bot_epm: float = 200.0
    many_pages: float = 100.0
    short_gap: float = 1.0
    full_cart_ratio: float = 1.0
    burst_duration: tuple[float, float] = (10.0, 20.0)
    low_diversity: tuple[int, int] = (1, 2)
    long_duration: float = 3600.0
    fast_payment: float = 60.0
    fast_signup: float = 60.0


def rule_flags(features: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One flag per rule band and the number of bands that fired."""
    epm, duration = F.col("events_per_minute"), F.col("session_duration_seconds")
    speed = F.col("signup_to_purchase_speed")
    flags = {
        "likely_bot": epm > bands.likely_bot_epm,
        "definite_bot": epm > bands.definite_bot_epm,
        "many_pages": F.col("unique_pages_visited") > bands.many_pages,
        "short_gap": F.col("avg_time_between_events") < bands.short_gap,
        "full_cart": F.col("cart_to_purchase_ratio") == bands.full_cart_ratio,
        "odd_duration": duration.between(*bands.burst_duration)
        | (duration >= bands.long_duration),
        "low_diversity": F.col("event_type_diversity").between(*bands.low_diversity),
        "fast_payment": (F.col("has_payment") == 1) & (duration < bands.fast_payment),
        "fast_signup_purchase": (speed > 0) & (speed < bands.fast_signup),
    }
    ints = {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in flags.items()}
    total = sum(ints.values(), F.lit(0))
    return features.select(
        "session_id",
        *[c.alias(n) for n, c in ints.items()],
        total.alias("flags"),
    )

"""Feature table semantics: contract, latest row, expiry, point-in-time reads."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.functions.expressions import exact_seconds, time_bucket
from sessionlens.operators.ordered import CHUNK, SLOT_SECONDS, last_before
from sessionlens.schema import SESSION_FEATURES, FeatureView


def enforce_contract(
    features: DataFrame, view: FeatureView = SESSION_FEATURES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Select and cast to the declared columns; fail when one is missing."""
    needed = [view.key, view.event_time, *view.features, *keep]
    missing = [c for c in needed if c not in features.columns]
    if missing:
        raise ValueError(f"{view.name}: missing columns {missing}")
    return features.select(
        F.col(view.key).cast("string").alias(view.key),
        F.col(view.event_time).cast("timestamp").alias(view.event_time),
        *[F.col(c).cast(t).alias(c) for c, t in view.fields.items()],
        *keep,
    )


def latest_per_session(
    rows: DataFrame,
    key: str = "session_id",
    order: tuple[str, ...] = ("event_timestamp",),
) -> DataFrame:
    """The newest row of each key.

    One aggregate with map-side combining: a key with many snapshots sends one
    row per task instead of all of them to one sort.
    """
    rest = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(*order, *_tiebreak(rest, order))).alias("_row")
    )
    return newest.select(key, "_row.*").select(*rows.columns)


def _tiebreak(rest: list[str], order: tuple[str, ...]) -> list[Column]:
    """Rows equal in the order columns: take the same one in every run."""
    others = [c for c in rest if c not in order]
    return [F.xxhash64(*others).alias("_tie")] if others else []


def compact_offline(history: DataFrame) -> DataFrame:
    """One row per session of the append-only history, the newest snapshot."""
    return latest_per_session(history)


def online_lookup_ttl(
    rows: DataFrame, now: Column, ttl: timedelta = SESSION_FEATURES.ttl
) -> DataFrame:
    """Latest row per session as the online store serves it at ``now``.

    Expired sessions keep their key and event time; their values are null.
    """
    latest = latest_per_session(rows)
    fresh = exact_seconds(F.col("event_timestamp"), now) <= F.lit(ttl.total_seconds())
    values = [c for c in rows.columns if c not in ("session_id", "event_timestamp")]
    return latest.select(
        "session_id",
        "event_timestamp",
        fresh.alias("fresh"),
        *[F.when(fresh, F.col(c)).alias(c) for c in values],
    )


def asof_feature_join(
    requests: DataFrame,
    history: DataFrame,
    features: list[str],
    key: str = "session_id",
    at: str = "asked_at",
    request_id: str = "request_id",
    ttl: timedelta | None = None,
    slot_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """For each request the newest feature row not after its time; misses stay.

    A request without a key or a time is a miss; feature rows without them serve nobody.
    Requests and feature rows are put on one time line per key and scanned once
    per (key, slot); the newest row of earlier slots is carried by a summary with
    one row per (key, slot), scanned in blocks of slots. Nothing is paired, so a key with many requests and
    many snapshots costs their sum, not their product.
    """
    ts = "event_timestamp"
    extra = [c for c in requests.columns if c not in (key, at)]
    value = F.struct(F.col(ts), *features)
    askable = F.col(key).isNotNull() & F.col(at).isNotNull()
    known = history.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    timeline = known.select(
        key,
        F.col(ts).alias("_at"),
        F.lit(0).alias("_ask"),
        value.alias("_value"),
        *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in extra],
    ).unionByName(
        requests.where(askable).select(
            key,
            F.col(at).alias("_at"),
            F.lit(1).alias("_ask"),
            F.lit(None).cast(history.select(value.alias("v")).schema["v"].dataType).alias("_value"),
            *extra,
        )
    )
    slotted = timeline.withColumn(CHUNK, time_bucket(F.col("_at"), slot_seconds))
    # Feature rows come before requests of the same instant.
    tie = F.xxhash64("_value")
    upto = W.partitionBy(key, CHUNK).orderBy("_at", "_ask", tie)
    scanned = slotted.withColumn(
        "_local", F.last("_value", ignorenulls=True).over(
            upto.rowsBetween(W.unboundedPreceding, W.currentRow)
        )
    ).where(F.col("_ask") == 1)

    newest = F.max_by("_value", F.when(F.col("_ask") == 0, F.struct("_at", tie)))
    slots = slotted.groupBy(key, CHUNK).agg(newest.alias("_newest"))
    carried = last_before(slots, key, "_newest", "_carried")
    found = scanned.join(carried, [key, CHUNK]).withColumn(
        "_hit", F.coalesce("_local", "_carried")
    )
    if ttl is not None:
        age = exact_seconds(F.col(f"_hit.{ts}"), F.col("_at"))
        found = found.withColumn(
            "_hit", F.when(age <= F.lit(ttl.total_seconds()), F.col("_hit"))
        )
    answered = found.select(
        key,
        F.col("_at").alias(at),
        *extra,
        F.col(f"_hit.{ts}").alias(ts),
        *[F.col(f"_hit.{c}").alias(c) for c in features],
    )
    misses = requests.where(~askable).select(
        key,
        at,
        *extra,
        *[F.lit(None).cast(history.schema[c].dataType).alias(c) for c in (ts, *features)],
    )
    return answered.unionByName(misses)

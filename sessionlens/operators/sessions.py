"""Cutting event streams into sessions: idle gaps, exits, size cap, end of input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.functions.expressions import (
    MICROS,
    exact_seconds,
    is_exit,
    time_bucket,
)
from sessionlens.operators.ordered import CHUNK, SLOT_SECONDS, ordered_scan, scan_slots

# Idle limit in seconds and event cap of a session buffer.
IDLE_SECONDS = 40
MAX_EVENTS = 500


def gap_segments(
    events: DataFrame, key: str, ts: str = "timestamp", gap_seconds: float = IDLE_SECONDS
) -> DataFrame:
    """Number the idle-gap segments of each key without sorting its events.

    Slots as wide as the gap cannot contain a break, so min/max per (key, slot)
    decide every break. The result has one row per (key, slot): its size follows
    keys times active slots, never the events of a hot key.
    """
    slots = events.groupBy(key, time_bucket(F.col(ts), gap_seconds).alias(CHUNK)).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(ts).alias("_first"),
        F.max(ts).alias(f"_last_{ts}"),
        F.lit(0).alias("_opened"),
        F.lit(None).cast("long").alias("_last_start"),
    )
    idle = F.unix_micros(ts) - F.unix_micros(f"prev_{ts}") > F.lit(int(gap_seconds * MICROS))
    scanned = scan_slots(slots, key, ts, [ts], idle)
    return scanned.select(key, CHUNK, F.col("_runs_before").alias("segment"))


def sessionize_gap(
    events: DataFrame,
    key: str,
    ts: str = "timestamp",
    gap_seconds: float = IDLE_SECONDS,
    into: str = "segment",
) -> DataFrame:
    """Add the idle-gap segment number (from 0) of each event within its key."""
    segments = gap_segments(events, key, ts, gap_seconds).withColumnRenamed(
        "segment", into
    )
    return (
        events.withColumn(CHUNK, time_bucket(F.col(ts), gap_seconds))
        .join(segments, [key, CHUNK])
        .drop(CHUNK)
    )


def session_order(
    events: DataFrame, chunk_seconds: float = SLOT_SECONDS
) -> DataFrame:
    """Position of each event in its session by (timestamp, event_id)."""
    scanned = ordered_scan(events, "session_id", chunk_seconds=chunk_seconds)
    return scanned.select(
        "session_id", "event_id", "timestamp", F.col("row_number").alias("event_number")
    )


def event_gaps(
    events: DataFrame, chunk_seconds: float = SLOT_SECONDS
) -> DataFrame:
    """Seconds since the previous event of the session; null for the first."""
    scanned = ordered_scan(events, "session_id", chunk_seconds=chunk_seconds)
    kept = [c for c in ("agent_type",) if c in events.columns]
    return scanned.select(
        "session_id",
        "event_id",
        "timestamp",
        *kept,
        exact_seconds(F.col("prev_timestamp"), F.col("timestamp")).alias("gap_seconds"),
    )


def session_first_last(events: DataFrame) -> DataFrame:
    """First and last event of each session by (timestamp, event_id)."""
    order = F.struct("timestamp", "event_id")
    return events.groupBy("session_id").agg(
        F.min_by("event_type", order).alias("first_event_type"),
        F.min_by("event_id", order).alias("first_event_id"),
        F.max_by("event_type", order).alias("last_event_type"),
        F.max_by("event_id", order).alias("last_event_id"),
    )


def interleave_events(events: DataFrame) -> DataFrame:
    """All events in global time order: a range-partitioned sort."""
    return events.orderBy("timestamp", "event_id")


def new_sessions(events: DataFrame) -> DataFrame:
    """First sighting of each session with the time it was seen."""
    return events.groupBy("session_id").agg(
        F.min("timestamp").alias("first_seen"),
        F.min_by("event_id", F.struct("timestamp", "event_id")).alias("first_event_id"),
    )


def sessions_seen_per_slot(events: DataFrame, slot_seconds: float) -> DataFrame:
    """New sessions per time slot and the running total of sessions seen.

    The running total scans one row per slot, whatever the number of sessions.
    """
    firsts = new_sessions(events).groupBy(
        time_bucket(F.col("first_seen"), slot_seconds).alias("slot")
    )
    counted = firsts.agg(F.count(F.lit(1)).alias("new_sessions"))
    upto = W.orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counted.withColumn("seen_sessions", F.sum("new_sessions").over(upto))


def assign_closures(
    events: DataFrame,
    key: str = "session_id",
    idle_seconds: float = IDLE_SECONDS,
    max_events: int = MAX_EVENTS,
    chunk_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """Assign each event to the buffer that would hold it.

    A buffer ends after an exit page, before an idle gap longer than
    ``idle_seconds``, or when it holds ``max_events``. Events are ordered by
    (timestamp, event_id). Adds ``run`` (exit/idle runs) and ``part`` (cap
    splits within a run) plus the scan columns.
    """
    idle = exact_seconds(F.col("prev_timestamp"), F.col("timestamp")) > F.lit(
        float(idle_seconds)
    )
    runs = ordered_scan(
        events,
        key,
        chunk_seconds=chunk_seconds,
        carry={"exit": is_exit()},
        starts=F.col("prev_exit") | idle,
    )
    part = F.call_function("div", F.col("run_row") - 1, F.lit(max_events))
    return runs.withColumn("part", part)


def close_reason(
    ends_with_exit: Column,
    size: Column,
    last_in_key: Column,
    last_seen: Column,
    max_events: int,
    idle_seconds: float,
    as_of: Column,
) -> Column:
    still_open = last_in_key & (
        exact_seconds(last_seen, as_of) <= F.lit(float(idle_seconds))
    )
    return (
        F.when(ends_with_exit, F.lit("exit"))
        .when(size >= max_events, F.lit("cap"))
        .when(still_open, F.lit("flush"))
        .otherwise(F.lit("idle"))
    )


def close_sessions(
    events: DataFrame,
    key: str = "session_id",
    idle_seconds: float = IDLE_SECONDS,
    max_events: int = MAX_EVENTS,
    chunk_seconds: float = SLOT_SECONDS,
    as_of: Column | None = None,
) -> DataFrame:
    """Closed session buffers with their close reason.

    One row per buffer: ``exit``, ``cap``, ``idle`` or, for buffers that are not
    yet idle at the end of the input, ``flush``. The end of the input is ``as_of``
    or else the newest event time.
    """
    if as_of is None:
        as_of = events.agg(F.max("timestamp")).scalar()
    assigned = assign_closures(events, key, idle_seconds, max_events, chunk_seconds)
    order = F.col("row_number")
    buffers = assigned.groupBy(key, "run", "part").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("timestamp").alias("opened_at"),
        F.max("timestamp").alias("last_seen"),
        F.max_by(is_exit(), order).alias("_exit"),
        F.max((F.col("row_number") == F.col("key_rows")).cast("int")).alias("_final"),
    )
    return buffers.select(
        key,
        "run",
        "part",
        "event_count",
        "opened_at",
        "last_seen",
        close_reason(
            F.col("_exit"),
            F.col("event_count"),
            F.col("_final") == 1,
            F.col("last_seen"),
            max_events,
            idle_seconds,
            as_of,
        ).alias("close_reason"),
    )


def missed_sessions(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """Sessions that were seen but never stored."""
    ids = seen.select("session_id").distinct()
    return ids.join(stored.select("session_id").distinct(), "session_id", "left_anti")


def coverage_counts(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """How many sessions were seen, stored and missed."""
    marks = (
        seen.select("session_id", F.lit(1).alias("seen"), F.lit(0).alias("stored"))
        .unionByName(
            stored.select("session_id", F.lit(0).alias("seen"), F.lit(1).alias("stored"))
        )
        .groupBy("session_id")
        .agg(F.max("seen").alias("seen"), F.max("stored").alias("stored"))
    )
    return marks.agg(
        F.count_if(F.col("seen") == 1).alias("seen"),
        F.count_if(F.col("stored") == 1).alias("stored"),
        F.count_if((F.col("seen") == 1) & (F.col("stored") == 0)).alias("missed"),
    )


# Arrival groups whose newest times are scanned together.
ARRIVAL_BLOCK = 4096
LATE_POLICIES = ("keep", "drop", "side")


def late_events(
    events: DataFrame,
    arrival: str,
    delay_seconds: float,
    policy: str = "side",
    block: int = ARRIVAL_BLOCK,
) -> DataFrame:
    """Events against the watermark formed by earlier arrival groups.

    ``arrival`` numbers the micro-batches. The watermark of a batch is the newest event
    time of all earlier batches minus the delay. ``policy`` says what is returned:
    ``side`` the late events with their ``watermark``, ``drop`` the other ones, ``keep``
    all events with the flag ``late``. Events without a time or an arrival are not late.

    The running maximum goes over one summary row per batch, in blocks of ``block``
    batches, and over one row per block; it never touches the events themselves.
    """
    if policy not in LATE_POLICIES:
        raise ValueError(f"policy {policy!r} is not one of {LATE_POLICIES}")
    newest = events.groupBy(arrival).agg(F.max("timestamp").alias("_newest"))
    newest = newest.withColumn("_block", F.floor(F.col(arrival) / block))
    earlier = (W.unboundedPreceding, -1)
    blocks = newest.groupBy("_block").agg(F.max("_newest").alias("_newest")).select(
        "_block",
        F.max("_newest").over(W.orderBy("_block").rowsBetween(*earlier)).alias("_carried"),
    )
    inside = W.partitionBy("_block").orderBy(arrival).rowsBetween(*earlier)
    marks = (
        newest.withColumn("_local", F.max("_newest").over(inside))
        .join(blocks, "_block")
        .select(
            arrival,
            (
                F.greatest("_local", "_carried")
                - F.make_dt_interval(secs=F.lit(delay_seconds))
            ).alias("watermark"),
        )
    )
    marked = events.join(marks, arrival, "left").withColumn(
        "late", F.coalesce(F.col("timestamp") < F.col("watermark"), F.lit(False))
    )
    if policy == "keep":
        return marked.select(*events.columns, "late")
    if policy == "drop":
        return marked.where(~F.col("late")).select(*events.columns)
    return marked.where("late").select(*events.columns, "watermark")

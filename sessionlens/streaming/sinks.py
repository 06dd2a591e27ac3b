"""Micro-batch sinks: history, online latest rows, and both with a log."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.operators.sketches import event_states, merge_states
from sessionlens.operators.store import latest_per_session, online_lookup_ttl
from sessionlens.schema import SESSION_FEATURES
from sessionlens.sources.offline import append_batch, scan_offline

BatchWriter = Callable[[DataFrame, int], None]


def offline_sink(path: str, run: str) -> BatchWriter:
    """Append every non-empty batch to the history."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cached = batch.persist()  # a stateful batch is computed once
        try:
            if not cached.isEmpty():
                append_batch(cached, path, run, batch_id)
        finally:
            cached.unpersist()

    return write


def online_sink(path: str, run: str) -> BatchWriter:
    """Add a batch's newest row per session to the online log.

    A write costs the batch, never the whole table; reading picks the newest row
    per key, and ``compact_online`` shortens the log. Among equal event times the last
    write wins: runs go by the number that ends their name, so that ``r10`` comes after
    ``r9``; a name without one stands for the first run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        cached = latest_per_session(batch).persist()
        try:
            if not cached.isEmpty():
                append_batch(cached, path, run, batch_id)
        finally:
            cached.unpersist()

    return write


#: What makes a row of the online log newer than another of its session.
WRITE_ORDER = ("event_timestamp", "run_number", "batch_id")


def _newest(rows: DataFrame) -> DataFrame:
    """Newest row per session of log rows, by event time and then by the order of writing."""
    number = F.regexp_extract(F.col("run").cast("string"), "([0-9]+)$", 1).try_cast("long")
    numbered = rows.drop("event_date").withColumn("run_number", F.coalesce(number, F.lit(-1)))
    return latest_per_session(numbered, order=WRITE_ORDER).drop("run", "batch_id", "run_number")


def read_online(spark: SparkSession, path: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Newest row per session, the last write winning among equal event times.

    With ``keys`` only those sessions are read, from the folders of their buckets.
    """
    return _newest(scan_offline(spark, path, keys=keys))


def lookup_online(
    spark: SparkSession,
    path: str,
    now: Column,
    ttl: timedelta = SESSION_FEATURES.ttl,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Unexpired rows at ``now``, of all sessions or of ``keys``.

    Only the event dates within the expiry, and the buckets of the keys, are read.
    """
    oldest = now - F.make_dt_interval(secs=F.lit(ttl.total_seconds()))
    recent = scan_offline(spark, path, keys=keys).where(F.col("event_date") >= F.to_date(oldest))
    return online_lookup_ttl(_newest(recent), now, ttl).where("fresh").drop("fresh")


def compact_online(spark: SparkSession, path: str, target: str, run: str) -> None:
    """Write the newest row per session as the first batch of a new online log."""
    append_batch(read_online(spark, path), target, run, 0)


def fan_out(offline: str, online: str, log: str, run: str) -> BatchWriter:
    """Both sinks and one log row per non-empty batch, computing the batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        started = time.monotonic()
        cached = batch.persist()
        try:
            rows = cached.count()
            if rows == 0:
                return
            append_batch(cached, offline, run, batch_id)
            append_batch(latest_per_session(cached), online, run, batch_id)
            entry = batch.sparkSession.createDataFrame(
                [(rows, time.monotonic() - started)], "rows long, seconds double"
            )
            entry.coalesce(1).write.mode("overwrite").parquet(
                f"{log}/run={run}/batch_id={batch_id}"
            )
        finally:
            cached.unpersist()

    return write


def state_sink(path: str, run: str) -> BatchWriter:
    """Reduce each batch of events to one mergeable state per session, in a folder of its own.

    The stream itself keeps no state; late events are a state more, and a replayed batch takes
    its folder's place.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        event_states(batch).write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")

    return write


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """States of all batches of all runs."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/run=*/batch_id=*")
    return rows.drop("run", "batch_id")


def compact_states(spark: SparkSession, path: str, target: str, run: str) -> None:
    """Write one state per session as the first batch of a new log."""
    merged = merge_states(read_states(spark, path))
    merged.write.mode("overwrite").parquet(f"{target}/run={run}/batch_id=0")

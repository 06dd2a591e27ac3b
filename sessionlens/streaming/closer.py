"""Session closure on a stream: each micro-batch cuts the events that its clock has passed.

The clock is the newest event time seen less the allowed delay. Events after it wait, events
before it are complete and are cut like a batch table, with each open buffer standing before
them as one row that counts for its events. Rows in any order within the delay therefore give
the same buffers as a sorted table. Rows older than the clock of an earlier batch are late:
they change no buffer and are kept aside. All of it is DataFrame work over the batch, the
waiting events and the open buffers, so a busy session is cut by slots like any other.

A batch writes one folder, with its closed buffers, late rows, and the state for the next
one: open buffers, waiting events and the clock. A replayed batch starts from the state
before it and replaces its folder, so a restart neither loses nor repeats a buffer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.functions.expressions import (
    MICROS,
    exact_seconds,
    is_exit,
    is_success_payment,
    is_type,
    page_key,
)
from sessionlens.operators.ordered import SLOT_SECONDS, ordered_scan
from sessionlens.operators.sessions import IDLE_SECONDS, MAX_EVENTS

#: An event, or a buffer as one row: ``timestamp`` is the time of its newest event and
#: ``weight`` their number.
_ROW = (
    "session_id string, timestamp timestamp, event_id string, weight long, opened timestamp, "
    "adds long, buys long, is_exit boolean, page string, pages array<string>"
)
_STATE = f"{_ROW}, close_reason string, flush int, kind string"


def closing_events(events: DataFrame) -> DataFrame:
    """What closure needs of decoded events; works on a stream and on a table."""
    return events.select(
        "session_id",
        "timestamp",
        "event_id",
        F.lit(1).cast("long").alias("weight"),
        F.col("timestamp").alias("opened"),
        is_type("add_to_cart").cast("long").alias("adds"),
        F.coalesce(is_success_payment(), F.lit(False)).cast("long").alias("buys"),
        is_exit().alias("is_exit"),
        page_key().alias("page"),
        F.lit(None).cast("array<string>").alias("pages"),
    )


class SessionCloser:
    """Cuts micro-batches of ``closing_events`` into buffers kept under ``path``."""

    def __init__(
        self,
        path: str,
        idle_seconds: float = IDLE_SECONDS,
        max_events: int = MAX_EVENTS,
        delay_seconds: float = 60.0,
        slot_seconds: float = SLOT_SECONDS,
    ) -> None:
        self.path = path.rstrip("/")
        self.idle_seconds = float(idle_seconds)
        self.max_events = max_events
        self.delay_us = int(delay_seconds * MICROS)
        self.slot_seconds = slot_seconds

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The writer of a streaming job, one call for each micro-batch in order."""
        spark = batch.sparkSession
        cached = batch.persist()
        try:
            state, clock = self._state(spark, batch_id - 1)
            moment = F.unix_micros("timestamp")
            seen = cached.agg(F.max(moment)).first()[0]
            newest = max((t for t in (clock, seen) if t is not None), default=None)
            if newest is None:
                rows = state
            else:
                before = None if clock is None else clock - self.delay_us
                late = F.lit(False) if before is None else moment < before
                passed = moment < newest - self.delay_us
                events = state.where("kind = 'waiting'").select(*cached.columns).union(cached.where(~late))
                rows = (
                    self._cut(state, events.where(passed), newest - self.delay_us, ended=False)
                    .unionByName(events.where(~passed).withColumn("kind", F.lit("waiting")), True)
                    .unionByName(cached.where(late).withColumn("kind", F.lit("late")), True)
                    .unionByName(_clock(spark, newest), True)
                )
            _save(rows, f"{self.path}/batch_id={batch_id}", 0)
        finally:
            cached.unpersist()

    def flush(self, spark: SparkSession) -> None:
        """Close what is open after the last batch, as at the end of the input.

        Buffers idle since the newest event are ``idle``, others ``flush``. The job may go on
        from the same checkpoint: its next batch begins without buffers, and rows older than
        the clock are late as before. Should it have to replay the last batch, that one
        replaces its folder, and the flush with it.
        """
        last = self._rows(spark).agg(F.max("batch_id")).first()[0]
        if last is None:
            return
        state, newest = self._state(spark, last)
        # Nothing was seen, or nothing is left since the last flush.
        if newest is None or state.where("kind in ('open', 'waiting')").isEmpty():
            return
        waiting = state.where("kind = 'waiting'").select(*[c.split()[0] for c in _ROW.split(", ")])
        rows = self._cut(state, waiting, newest, ended=True).unionByName(_clock(spark, newest), True)
        _save(rows, f"{self.path}/batch_id={last}", 1)

    def closed(self, spark: SparkSession) -> DataFrame:
        """All closed buffers with their features and the reason of closing."""
        n, adds = F.col("weight"), F.col("adds")
        seconds = exact_seconds(F.col("opened"), F.col("timestamp"))
        per_minute = F.when(seconds > 0, n / seconds * 60).otherwise(n.cast("double"))
        return self._rows(spark).where("kind = 'closed'").select(
            "session_id",
            F.col("opened").alias("opened_at"),
            F.col("timestamp").alias("last_seen"),
            n.alias("event_count"),
            F.when(n >= 2, per_minute).otherwise(0.0).alias("events_per_minute"),
            F.size("pages").cast("double").alias("unique_pages"),
            F.coalesce(F.try_divide(seconds, n - 1), F.lit(0.0)).alias("avg_gap"),
            F.coalesce(F.try_divide("buys", adds), F.lit(0.0)).alias("cart_ratio"),
            "close_reason",
        )

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that came after the clock had passed them, with the batch that brought them."""
        return self._rows(spark).where("kind = 'late'").select(
            "session_id", "event_id", "timestamp", "batch_id"
        )

    def _rows(self, spark: SparkSession) -> DataFrame:
        read = spark.read.schema(f"{_STATE}, batch_id long").option("basePath", self.path)
        return read.parquet(self.path)

    def _state(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, int | None]:
        """Rows left by a batch, or by the flush after it, and the newest time seen."""
        if batch_id < 0:
            return spark.createDataFrame([], _STATE), None
        path = f"{self.path}/batch_id={batch_id}"
        rows = spark.read.schema(_STATE).option("basePath", path).parquet(path)
        clocks = rows.where("kind = 'clock'").select("flush", F.unix_micros("timestamp").alias("us"))
        clock = clocks.orderBy(F.desc("flush")).first()
        if clock is None:
            return spark.createDataFrame([], _STATE), None
        return rows.where(F.col("flush") == clock["flush"]), clock["us"]

    def _cut(self, state: DataFrame, events: DataFrame, now_us: int, ended: bool) -> DataFrame:
        """Buffers of the open ones and the events after them: closed, or open at ``now_us``."""
        opened = state.where("kind = 'open'").select(*events.columns)
        idle = exact_seconds(F.col("prev_timestamp"), F.col("timestamp")) > self.idle_seconds
        scanned = ordered_scan(
            opened.union(events),
            "session_id",
            chunk_seconds=self.slot_seconds,
            carry={"exit": F.col("is_exit")},
            starts=F.col("prev_exit") | idle,
            weight=F.col("weight"),
        )
        part = F.call_function("div", F.col("run_row") - 1, F.lit(self.max_events))
        # A buffer holds at most ``max_events`` events, and so as many pages.
        pages = F.array_union(
            F.coalesce(F.max("pages"), F.array().cast("array<string>")), F.collect_set("page")
        )
        buffers = scanned.withColumn("part", part).groupBy("session_id", "run", "part").agg(
            F.max("timestamp").alias("timestamp"),
            F.sum("weight").alias("weight"),
            F.min("opened").alias("opened"),
            F.sum("adds").alias("adds"),
            F.sum("buys").alias("buys"),
            F.max_by("is_exit", "row_number").alias("is_exit"),
            pages.alias("pages"),
            F.max(F.col("row_number") == F.col("key_rows")).alias("last"),
        )
        quiet = F.lit(now_us) - F.unix_micros("timestamp") > int(self.idle_seconds * MICROS)
        reason = (
            F.when(F.col("is_exit"), "exit")
            .when(F.col("weight") >= self.max_events, "cap")
            .when(~F.col("last") | quiet, "idle")
        )
        reason = F.coalesce(reason, F.lit("flush")) if ended else reason
        return (
            buffers.withColumn("close_reason", reason)
            .withColumn("kind", F.when(F.col("close_reason").isNull(), "open").otherwise("closed"))
            .withColumn("event_id", F.lit(""))
            .drop("run", "part", "last")
        )


def _clock(spark: SparkSession, newest: int) -> DataFrame:
    return spark.range(1).select(
        F.timestamp_micros(F.lit(newest)).alias("timestamp"), F.lit("clock").alias("kind")
    )


def _save(rows: DataFrame, path: str, flush: int) -> None:
    """One folder a batch, with a folder for each kind of row; a flush adds its own."""
    names = [c.split()[0] for c in _STATE.split(", ") if not c.startswith("flush")]
    whole = rows.select(*[F.col(n) if n in rows.columns else F.lit(None).alias(n) for n in names])
    target = path if flush == 0 else f"{path}/flush={flush}"
    parts = ["flush", "kind"] if flush == 0 else ["kind"]
    whole = whole.withColumn("flush", F.lit(flush)) if flush == 0 else whole
    whole.write.mode("overwrite").partitionBy(*parts).parquet(target)


def stream_close_sessions(events: DataFrame) -> DataFrame:
    """The stream of events whose micro-batches ``SessionCloser.write`` cuts."""
    return closing_events(events)

"""Streaming jobs: live features, idle sessions, and how they are started."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlens.operators.decode import decode_checked, decode_events, drop_tombstones
from sessionlens.operators.live import WATERMARK, live_session_features
from sessionlens.operators.validate import quarantine_events
from sessionlens.streaming.sinks import BatchWriter

# An event far ahead of all data moves the watermark past every idle window.
END_SESSION = "__end__"
END_TIME = datetime(2200, 1, 1, tzinfo=timezone.utc)


def events_from(messages: DataFrame) -> DataFrame:
    """Decoded events of a message stream that name their session and time.

    Unreadable messages decode to all-null rows, which would otherwise share one
    session; ``stream_quarantine`` on the same messages keeps them.
    """
    decoded = decode_events(drop_tombstones(messages))
    return decoded.where(F.col("session_id").isNotNull() & F.col("timestamp").isNotNull())


def stream_quarantine(messages: DataFrame) -> DataFrame:
    """Messages that break a rule, with the reasons, in append mode; no state."""
    return quarantine_events(decode_checked(messages))


def stream_live_features(messages: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Live features per session for update mode.

    The watermark column is not part of the key, so a late event still updates
    its session and no session's state is dropped. ``stream_session_window``
    gives up late events in exchange for bounded state.
    """
    return live_session_features(events_from(messages).withWatermark("timestamp", delay))


def stream_new_sessions(messages: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """First event seen of every session, in append mode."""
    events = events_from(messages).withWatermark("timestamp", delay)
    return events.select("session_id", "timestamp", "event_id").dropDuplicates(["session_id"])


def stream_unique_events(messages: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Events with repeated ids dropped while the watermark has not passed them."""
    events = events_from(messages).withWatermark("timestamp", delay)
    return events.dropDuplicatesWithinWatermark(["event_id"])


def stream_session_window(
    events: DataFrame, key: str, gap: str = "40 seconds", delay: str = WATERMARK
) -> DataFrame:
    """Idle-gap sessions of a key, in append mode: emitted once closed, then evicted."""
    window = F.session_window("timestamp", gap)
    grouped = events.withWatermark("timestamp", delay).groupBy(key, window.alias("w"))
    return grouped.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("timestamp").alias("opened_at"),
        F.max("timestamp").alias("last_seen"),
    ).drop("w")


SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNLOAD = "spark.sql.streaming.stateStore.unloadOnCommit"


def state_stores(spark: SparkSession) -> int:
    """State stores for a job that runs alone: one a core, or fewer if the session shuffles to fewer.

    Each store is opened and committed in every batch, whatever it holds, and all lie in the
    executors' memory: more of them than cores add to the time of a batch and nothing else.
    """
    return min(int(spark.conf.get(SHUFFLE_PARTITIONS)), spark.sparkContext.defaultParallelism)


def start(
    stream: DataFrame,
    checkpoint: str,
    write: BatchWriter,
    mode: str = "update",
    every: str | None = None,
    stores: int | None = None,
    on_disk: bool = False,
) -> StreamingQuery:
    """Start a job with a checkpoint; ``every`` is the trigger interval.

    Without an interval all available input is processed and the job ends. ``stores`` is the
    number of its state stores, by default the session's shuffle partitions; a checkpoint
    keeps the number it was begun with.

    ``on_disk`` keeps the state on the executors' disks, unless the session names a provider
    or the checkpoint was begun with another, and closes the stores with their tasks. For jobs
    that restart often: stores would stay open for up to a minute after their run, so that many
    states lie side by side in memory; a start also reads the state as it is, not all changes
    since the last snapshot. Native stores that are open when a JVM exits can crash it.
    """
    spark = stream.sparkSession
    wanted = {SHUFFLE_PARTITIONS: stores} if stores else {}
    if on_disk and not spark.conf.get(STATE_PROVIDER, None):
        wanted |= {STATE_PROVIDER: ON_DISK, UNLOAD: True}
    held = {key: spark.conf.get(key, None) for key in wanted}
    try:  # the job takes a copy of the session's settings as it starts
        for key, value in wanted.items():
            spark.conf.set(key, value)
        return _start(stream, checkpoint, write, mode, every)
    finally:
        for key, value in held.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _start(
    stream: DataFrame, checkpoint: str, write: BatchWriter, mode: str, every: str | None
) -> StreamingQuery:
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    if every:
        return writer.trigger(processingTime=every).start()
    return writer.trigger(availableNow=True).start()


def drain(
    stream: DataFrame,
    checkpoint: str,
    write: BatchWriter,
    mode: str = "update",
    timeout: int | None = None,
    stores: int | None = None,
    on_disk: bool = False,
) -> StreamingQuery:
    """Process all available input and wait for the end, or at most ``timeout`` seconds."""
    query = start(stream, checkpoint, write, mode, stores=stores, on_disk=on_disk)
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream did not end within {timeout} s")
    if query.exception():
        raise query.exception()
    return query


def drain_to_files(
    stream: DataFrame, checkpoint: str, path: str, mode: str = "append", timeout: int | None = None
) -> StreamingQuery:
    """Drain into one parquet folder per batch, for streams without an event time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return drain(stream, checkpoint, write, mode, timeout)


def batch_metrics(query: StreamingQuery) -> list[dict[str, float]]:
    """Rows, seconds and state rows of each finished micro-batch."""
    return [
        {
            "batch_id": p.batchId,
            "rows": p.numInputRows,
            "seconds": p.batchDuration / 1000.0,
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
        }
        for p in query.recentProgress
    ]


def record_metrics(query: StreamingQuery, path: str) -> None:
    """Write a row for each micro-batch of a run to a table, in a folder of the run's own.

    A run has a few numbers for each of its batches; recording it again replaces its folder.
    """
    spark = SparkSession.active()
    rows = [tuple(m.values()) for m in batch_metrics(query)]
    table = spark.createDataFrame(rows, "batch_id long, rows long, seconds double, state_rows long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/run_id={query.runId}")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Batches of all recorded runs; a batch that was replayed counts in its last run."""
    return spark.read.option("basePath", path).parquet(path)


class InjectedFault(RuntimeError):
    """Raised by ``FailOnce``."""


class FailOnce:
    """A writer that loses every batch once, after its write and before its commit."""

    def __init__(self, write: BatchWriter) -> None:
        self._write = write
        self.lost: list[int] = []

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._write(batch, batch_id)
        if batch_id not in self.lost:
            self.lost.append(batch_id)
            raise InjectedFault(f"batch {batch_id} is lost between write and commit")

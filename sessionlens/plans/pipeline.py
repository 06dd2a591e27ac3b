"""The composed plans: events to features, history, detectors and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.ml.autoencoder import Autoencoder
from sessionlens.ml.evaluate import flag_above, flag_top_share
from sessionlens.ml.frame import (
    eval_union,
    split_normal_anomaly,
    split_train_test,
    training_frame,
)
from sessionlens.ml.iforest import CONTAMINATION, SEED, IsolationForest
from sessionlens.ml.quantile import exact_quantile
from sessionlens.operators.aggregates import row_mse
from sessionlens.operators.features import session_features
from sessionlens.operators.ordered import SLOT_SECONDS
from sessionlens.operators.sessions import assign_closures
from sessionlens.session import ensure_checkpoint_dir, fresh_dir
from sessionlens.sources.topic import read_message_files
from sessionlens.streaming.jobs import InjectedFault, drain, record_metrics, state_stores
from sessionlens.streaming.sinks import BatchWriter

# Fixed value: train errors above this quantile count as anomalous.
ERROR_QUANTILE = 0.95


# Messages of a replayed slice; there are two slices at least, to cross a restart.
WAVE_ROWS = 1_000_000


def stored(rows: DataFrame) -> DataFrame:
    """Materialise rows that several passes will read, in the shared folder."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def staged(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Rows written to parquet in the shared folder, so that a pass reads its columns and, with
    ``by``, its slices alone. Unlike ``stored`` it compresses; use it for wide rows.
    """
    spark = rows.sparkSession
    path = fresh_dir(spark, "staged")
    (rows.write.partitionBy(by) if by else rows.write).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def closed_history(
    events: DataFrame,
    idle_seconds: float,
    max_events: int,
    chunk_seconds: float = SLOT_SECONDS,
) -> DataFrame:
    """Feature snapshots of every closed buffer: several rows per session over time."""
    assigned = assign_closures(
        events,
        idle_seconds=idle_seconds,
        max_events=max_events,
        chunk_seconds=chunk_seconds,
    )
    rows = session_features(
        assigned,
        keys=("session_id", "run", "part"),
        keep=("session_end", "agent_type", "event_count"),
    )
    return rows.withColumnRenamed("session_end", "event_timestamp").drop("run", "part")


def held_out_split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training rows, evaluation rows): normals are split, anomalies all evaluated."""
    normal, anomalies = split_normal_anomaly(stored(training_frame(rows)))
    marked = split_train_test(normal)
    train = marked.where(~F.col("held_out")).drop("held_out")
    held_out = marked.where(F.col("held_out")).drop("held_out")
    return train, eval_union(held_out, anomalies)


def isolation_forest_run(
    rows: DataFrame, contamination: float = CONTAMINATION, seed: int = SEED
) -> DataFrame:
    """Fit on all rows, score them, flag the top share."""
    frame = stored(training_frame(rows))
    scored = stored(IsolationForest.fit(frame, seed=seed).score(frame))
    return flag_top_share(scored, "score", contamination)


def reconstruction_errors(model: Autoencoder, rows: DataFrame) -> DataFrame:
    rebuilt = model.reconstruct(rows)
    return row_mse(rebuilt, "scaled", "reconstruction").drop("scaled", "reconstruction")


def autoencoder_run(rows: DataFrame, quantile: float = ERROR_QUANTILE, **fit: object) -> DataFrame:
    """Fit on normal training rows, flag evaluation rows above the error quantile."""
    train, evaluation = held_out_split(rows)
    model = Autoencoder.fit(train, **fit)
    threshold = exact_quantile(
        stored(reconstruction_errors(model, train)), "error", quantile
    )
    return flag_above(reconstruction_errors(model, evaluation), "error", threshold)


def drain_in_waves(
    messages: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    write: BatchWriter,
    mode: str,
    waves: int | None = None,
    last: DataFrame | None = None,
    metrics: str | None = None,
    may_fail: bool = False,
) -> None:
    """Replay stored messages as a stream: publish a time slice, drain it, repeat.

    Without ``waves`` there is a slice for every WAVE_ROWS messages, two at least.

    Every wave restarts the job from its checkpoint and is one micro-batch, with the state
    on disk; the optional ``last`` messages form a final wave. ``messages`` carry ``timestamp``; they are
    written by slice once, so that a wave reads its own slice and not all messages.
    With ``metrics`` each run's batches are recorded in that table; with ``may_fail`` a run
    that ends in an injected fault is started again.
    """
    spark = messages.sparkSession
    inbox, checkpoint = fresh_dir(spark, "inbox"), fresh_dir(spark, "checkpoint")
    kept = staged(messages)
    span = kept.agg(
        F.min(F.unix_micros("timestamp")).alias("lo"),
        F.max(F.unix_micros("timestamp")).alias("hi"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    waves = waves or max(2, -(-span["n"] // WAVE_ROWS))
    width = (span["hi"] - span["lo"]) // waves + 1
    wave = F.call_function(
        "div", F.unix_micros("timestamp") - F.lit(span["lo"]), F.lit(width)
    )
    dealt = staged(
        kept.select("key", "value", wave.alias("wave")).where("wave is not null"), by="wave"
    )
    slices = [dealt.where(F.col("wave") == i) for i in range(waves)]
    if last is not None:
        slices.append(last)
    for part in slices:
        part.select("key", "value").write.mode("append").parquet(inbox)
        query = None
        while query is None:  # every batch is lost once at most
            try:
                stream = build(read_message_files(spark, inbox))
                query = drain(
                    stream, checkpoint, write, mode, stores=state_stores(spark), on_disk=True
                )
            except StreamingQueryException as lost:
                if not may_fail or InjectedFault.__name__ not in str(lost):
                    raise
        if metrics:
            record_metrics(query, metrics)


def end_marker(spark: SparkSession, session_id: str, at: object) -> DataFrame:
    """One message far ahead in time that lets every open session of a stream close."""
    body = F.to_json(
        F.struct(
            F.lit("end").alias("event_id"),
            F.lit(session_id).alias("session_id"),
            F.lit(session_id).alias("user_id"),
            F.lit(at).alias("timestamp"),
        )
    )
    return spark.range(1).select(
        F.lit(session_id).alias("key"), body.cast("binary").alias("value")
    )

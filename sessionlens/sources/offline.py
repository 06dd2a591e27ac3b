"""Append-only feature history in parquet, by event date and key bucket.

Folders go by event date, key bucket and part: a part is one batch of a run, or what a
compaction made of many. Batches are small and go to a bucket of their own (-1), a file or a
few for each date; a compaction deals them over the key buckets. Rows keep their run and
batch in the files. A manifest beside the
history says for each date which compaction counts and up to which batch of each run it
holds the rows, so a reader sees every row once while a compaction is under way, after one
that was cut short, and when a batch is replayed that has been compacted already.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the key in each compacted date, a number that a history keeps, and the bucket
#: of batches that have not been compacted.
BUCKETS, UNSORTED = 8, -1
#: Columns that a history adds to the rows beside ``run``, ``batch_id`` and ``event_date``.
LAYOUT = ("key_bucket", "part", "generation")
MANIFEST = "event_date date, run string, generation long, covered long"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str) -> None:
    """Parts of ``rows`` replace their own folders and no others."""
    folders = ("event_date", "key_bucket", "part")
    (
        # Rows of a folder come together, large folders in several tasks; sorted keys let a
        # reader of one key skip most of its bucket's row groups.
        rows.hint("rebalance", "event_date", "key_bucket")
        .sortWithinPartitions(*folders, key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(path)
    )


def append_batch(
    rows: DataFrame,
    path: str,
    run: str,
    batch_id: int,
    event_time: str = "event_timestamp",
    key: str = "session_id",
) -> None:
    """Add one batch of rows as a part of its own in each date it touches.

    A replayed batch, which holds the same rows, replaces its own folders, so a retry after
    a failure cannot duplicate rows. ``run`` must be new for every new checkpoint, because
    batch ids start again at 0 there, and batches of a run are written one after another.
    """
    placed = rows.withColumns(
        {
            "event_date": F.to_date(event_time),
            "key_bucket": F.lit(UNSORTED),
            "part": F.lit(f"b-{run}-{batch_id}"),
            "run": F.lit(run),
            "batch_id": F.lit(batch_id).cast("long"),
            "generation": F.lit(0).cast("long"),
        }
    )
    _write(placed, path, key)


def _read(spark: SparkSession, path: str, folders: str) -> DataFrame:
    """Rows of the folders that a pattern names; nothing else is listed if any of them exist."""
    reader = spark.read.option("basePath", path)
    try:
        return reader.parquet(f"{path}{folders}")
    except AnalysisException as absent:
        if not folders or absent.getCondition() != "PATH_NOT_FOUND":
            raise
    return reader.parquet(path).limit(0)


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """What the latest compaction of each date holds; None before the first one."""
    try:
        log = spark.read.schema(MANIFEST).parquet(f"{path}.manifest")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    latest = log.groupBy("event_date").agg(F.max("generation").alias("generation"))
    return log.join(latest, ["event_date", "generation"]).withColumnRenamed("generation", "live")


def _parts(
    spark: SparkSession,
    path: str,
    dates: Iterable[date] | None = None,
    keys: Sequence[str] | None = None,
    buckets: int = BUCKETS,
    key: str = "session_id",
) -> DataFrame:
    """All rows in the folders of the dates and keys, with ``counts``: whether a row is live."""
    days = None if dates is None else ",".join(sorted({d.isoformat() for d in dates}))
    folders = "" if days is None else f"/event_date={{{days}}}"
    if keys is not None:
        # One row for each key that the caller names.
        asked = spark.createDataFrame([(k,) for k in keys], f"{key} string")
        found = asked.select(_bucket(F.col(key), buckets)).distinct().collect()
        held = ",".join(str(b) for b in (UNSORTED, *(r[0] for r in found)))
        folders = (folders or "/event_date=*") + f"/key_bucket={{{held}}}"
    rows = _read(spark, path, folders)
    if keys is not None:
        rows = rows.where(F.col(key).isin(list(keys)))
    known = _manifest(spark, path)
    if known is None:
        return rows.withColumn("counts", F.col("generation") == 0)
    pending = F.col("covered").isNull() | (F.col("batch_id") > F.col("covered"))
    counts = F.when(F.col("generation") == 0, pending).otherwise(
        F.coalesce(F.col("generation") == F.col("live"), F.lit(False))
    )
    return rows.join(known, ["event_date", "run"], "left").withColumn("counts", counts).drop("live", "covered")


def scan_offline(
    spark: SparkSession,
    path: str,
    dates: Iterable[date] | None = None,
    keys: Sequence[str] | None = None,
    buckets: int = BUCKETS,
    key: str = "session_id",
) -> DataFrame:
    """The history, with ``run``, ``batch_id`` and ``event_date`` as columns.

    With ``dates`` or ``keys`` it holds their rows alone, and only their folders are listed;
    dates and keys that the history does not know give no rows.
    """
    rows = _parts(spark, path, dates, keys, buckets, key)
    return rows.where("counts").drop("counts", *LAYOUT)


def compact_history(
    spark: SparkSession,
    path: str,
    dates: Sequence[date],
    ended: Sequence[str] = (),
    key: str = "session_id",
    buckets: int = BUCKETS,
) -> None:
    """Merge the parts of the given dates into one for each date and key bucket.

    Jobs may go on appending. The newest batch of a run in a date may still be under way
    and stays a part of its own, except in the runs named ``ended``. The merged rows count
    from the moment the manifest names them; one compaction may run at a time.
    """
    live = _parts(spark, path, dates).where("counts").drop("counts")
    newest = (
        live.where("generation = 0")
        .groupBy("event_date", "run")
        .agg(F.max("batch_id").alias("newest"))
        .where(~F.col("run").isin(list(ended)))
    )
    known = _manifest(spark, path)
    last = known.agg(F.max("live")).first()[0] if known is not None else 0
    generation = F.lit((last or 0) + 1).cast("long")
    settled = (
        live.join(newest, ["event_date", "run"], "left")
        .where("generation > 0 or newest is null or batch_id < newest")
        .drop("newest")
        .withColumns(
            {
                "key_bucket": _bucket(F.col(key), buckets),
                "part": F.concat(F.lit("m-"), generation),
                "generation": generation,
            }
        )
    )
    _write(settled, path, key)
    # The manifest is made from what was written: batches that came meanwhile are not in it.
    days = ",".join(sorted({d.isoformat() for d in dates}))
    merged = _read(spark, path, f"/event_date={{{days}}}").where(F.col("generation") == generation)
    entry = merged.groupBy("event_date", "run").agg(
        F.max("generation").alias("generation"), F.max("batch_id").alias("covered")
    )
    entry.coalesce(1).write.mode("append").parquet(f"{path}.manifest")


def vacuum_history(spark: SparkSession, path: str, dates: Sequence[date]) -> int:
    """Remove the folders of the given dates that no longer count, and say how many.

    Readers that started before the last compaction may still need them: leave these time.
    """
    folders = (
        _parts(spark, path, dates)
        .groupBy("event_date", "key_bucket", "part")
        .agg(F.bool_or("counts").alias("needed"))
        .where("not needed")
        .select("event_date", "key_bucket", "part")
        .collect()
    )
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for day, bucket, part in folders:
        files.delete(hadoop.Path(root, f"event_date={day}/key_bucket={bucket}/part={part}"), True)
    return len(folders)

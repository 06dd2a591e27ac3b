"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.session import fresh_dir

#: Rows of an Arrow batch: whole texts can be long, so a batch holds few of them.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, read by Spark alone."""
    lean_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that go to Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder and read them back.

    Later steps start from the files, so a lost executor costs a reread only.
    """
    path = fresh_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def free_name(rows: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it until no column has that name."""
    taken = {c.lower() for c in rows.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def label_fold(doc_id: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def hash_share(column: str, seed: int, share: float) -> F.Column:
    """True for about ``share`` of the values, chosen by their hash."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 20)) < int(
        round(min(1.0, share) * (1 << 20))
    )

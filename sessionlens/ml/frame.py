"""Labels, null fill, training frame and repeatable splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.expressions import hash_rank
from sessionlens.ml.quantile import kth_smallest
from sessionlens.schema import ANOMALOUS_AGENTS, FEATURE_COLUMNS

# Held-out share and seed of the split.
TEST_SHARE = 0.3
SPLIT_SEED = 42


def label_agents(rows: DataFrame) -> DataFrame:
    """Add ``label``: 1 for bot and fraud sessions, else 0."""
    anomalous = F.col("agent_type").isin(*ANOMALOUS_AGENTS)
    return rows.withColumn("label", F.coalesce(anomalous, F.lit(False)).cast("int"))


def fill_features(rows: DataFrame) -> DataFrame:
    return rows.fillna(0, subset=[c for c in FEATURE_COLUMNS if c in rows.columns])


def training_frame(rows: DataFrame) -> DataFrame:
    """Labelled rows with null features set to 0."""
    return fill_features(label_agents(rows))


def split_normal_anomaly(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("label") == 0), rows.where(F.col("label") == 1)


def split_train_test(
    rows: DataFrame,
    test_share: float = TEST_SHARE,
    seed: int = SPLIT_SEED,
    key: str = "session_id",
) -> DataFrame:
    """Add ``held_out``: true for exactly ``ceil(share * n)`` rows.

    Rows rank by a hash of key and seed. Only the cut value is looked up, by
    narrowing aggregates, so no global sort or single-task ranking takes place.
    """
    ranked = rows.withColumn("_rank", hash_rank(F.col(key), seed))
    n = rows.count()
    wanted = math.ceil(test_share * n)
    if wanted == 0:
        return rows.withColumn("held_out", F.lit(False))
    cut = kth_smallest(ranked, "_rank", wanted)
    return ranked.withColumn("held_out", F.col("_rank") <= F.lit(cut)).drop("_rank")


def eval_union(held_out_normal: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The evaluation rows: held-out normal sessions and all anomalies."""
    return held_out_normal.unionByName(anomalies)

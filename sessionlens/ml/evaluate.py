"""Flags, confusion counts, reports and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.ml.quantile import exact_quantile

# Names of the logged metrics.
ANOMALY_METRICS = {
    "precision": "precision_anomaly",
    "recall": "recall_anomaly",
    "f1": "f1_anomaly",
}
AGENT_METRICS = {"bot": "bot_recall", "fraud": "fraud_recall"}


def flag_above(rows: DataFrame, score: str, threshold: float | Column) -> DataFrame:
    """``prediction`` 1 where the score lies above the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return rows.withColumn("prediction", (F.col(score) > limit).cast("int"))


def flag_top_share(rows: DataFrame, score: str, share: float) -> DataFrame:
    """``prediction`` 1 for the top ``share`` of scores."""
    return flag_above(rows, score, exact_quantile(rows, score, 1.0 - share))


def confusion_matrix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("rows"))


def classification_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and the means.

    Works on the confusion counts, at most four rows, so one small aggregate
    follows the pass over the data.
    """
    def cell(label: int, prediction: int) -> Column:
        hit = (F.col("label") == label) & (F.col("prediction") == prediction)
        return F.coalesce(F.sum(F.when(hit, F.col("rows"))), F.lit(0))

    counts = confusion_matrix(rows).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"), cell(1, 1).alias("tp"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def one_class(name: str, hit: Column, wrongly: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hit, hit + wrongly).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(2 * hit, 2 * hit + wrongly + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    classes = counts.select(
        one_class("0", tn, fn, fp).alias("n"),
        one_class("1", tp, fp, fn).alias("a"),
        ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
    )
    total = F.col("n.support") + F.col("a.support")

    def mean(name: str, weight_n: Column, weight_a: Column) -> Column:
        def over(metric: str) -> Column:
            weighted = F.col(f"n.{metric}") * weight_n + F.col(f"a.{metric}") * weight_a
            return ratio(weighted, weight_n + weight_a)

        return F.struct(
            F.lit(name).alias("class"),
            over("precision").alias("precision"),
            over("recall").alias("recall"),
            over("f1").alias("f1"),
            total.alias("support"),
        )

    accuracy = F.struct(
        F.lit("accuracy").alias("class"),
        F.col("accuracy").alias("precision"),
        F.col("accuracy").alias("recall"),
        F.col("accuracy").alias("f1"),
        total.alias("support"),
    )
    one = F.lit(1)
    return classes.select(
        F.inline(
            F.array(
                F.col("n"),
                F.col("a"),
                accuracy,
                mean("macro avg", one, one),
                mean("weighted avg", F.col("n.support"), F.col("a.support")),
            )
        )
    )


def recall_by_agent(rows: DataFrame) -> DataFrame:
    """Sessions per agent type: total, caught, missed and the share caught."""
    caught, missed = F.count_if(F.col("prediction") == 1), F.count_if(F.col("prediction") == 0)
    return rows.groupBy("agent_type").agg(
        F.count(F.lit(1)).alias("total"),
        caught.alias("caught"),
        missed.alias("missed"),
        (caught / F.count(F.lit(1))).alias("recall"),
    )


def run_rows(
    spark: SparkSession, run: str, params: dict[str, object], report: DataFrame, agents: DataFrame
) -> DataFrame:
    """Parameters and metrics of one evaluation as (run, kind, key, value) rows."""
    given = spark.createDataFrame(
        [(run, "param", k, str(v)) for k, v in params.items()],
        "run string, kind string, key string, value string",
    )
    anomaly = report.where(F.col("class") == "1").select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("key"),
                        F.col(m).cast("string").alias("value"),
                    )
                    for m, name in ANOMALY_METRICS.items()
                ]
            )
        )
    )
    by_agent = agents.where(F.col("agent_type").isin(*AGENT_METRICS)).select(
        F.when(F.col("agent_type") == "bot", F.lit(AGENT_METRICS["bot"]))
        .otherwise(F.lit(AGENT_METRICS["fraud"]))
        .alias("key"),
        F.col("recall").cast("string").alias("value"),
    )
    metrics = anomaly.unionByName(by_agent).select(
        F.lit(run).alias("run"), F.lit("metric").alias("kind"), "key", "value"
    )
    return given.unionByName(metrics)


def log_run(rows: DataFrame, path: str) -> None:
    """Append one evaluation to the runs table."""
    stamped = rows.withColumn("logged_at", F.current_timestamp())
    stamped.coalesce(1).write.mode("append").parquet(path)

"""View of the ``events`` test table as typed shop events.

The table has no session, url, product, status or agent; all are derived from
its columns by fixed rules, over every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.functions.expressions import computed_once
from sessionlens.operators.sessions import sessionize_gap
from sessionlens.schema import FULL_EVENT

SESSION_GAP_SECONDS = 24 * 3600


def _event_type(kind: Column, k: Column) -> Column:
    return (
        F.when(kind == "view", F.when(k < 50, "pageview").otherwise("product_view"))
        .when(
            kind == "click",
            F.when(k < 40, "add_to_cart")
            .when(k < 60, "checkout")
            .when(k < 80, "search")
            .otherwise("click"),
        )
        .when(kind == "purchase", "payment")
        .when(kind == "signup", "user_signup")
        .when(kind == "error", F.when(k < 50, "payment").otherwise("pageview"))
    )


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Share the rows of a table with fewer splits than cores; others pass as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events with flat ``ip`` and ``agent_type``, not yet cut into sessions."""
    raw = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        "user_id",
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    kind, k, etype = F.col("kind"), F.col("k"), F.col("event_type")
    typed = raw.withColumn("event_type", _event_type(kind, k))

    def only(name: str, value: Column) -> Column:
        return F.when(etype == name, value)

    agent = F.col("user_id") % 10
    return typed.select(
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        "timestamp",
        F.col("user_id").cast("string").alias("user_id"),
        F.when((kind == "view") & (k < 50), F.concat(F.lit("/p/"), (k % 10).cast("string")))
        .when((kind == "error") & (k >= 50), F.lit("/exit"))
        .alias("url"),
        F.when(
            etype.isin("product_view", "add_to_cart"),
            F.concat(F.lit("prod_"), F.lpad((k % 50 + 1).cast("string"), 3, "0")),
        ).alias("product_id"),
        F.when(kind == "purchase", F.lit("success"))
        .when((kind == "error") & (k < 50), F.lit("failed"))
        .alias("status"),
        F.concat(
            F.lit("45.12."),
            (F.expr("user_id div 5") % 256).cast("string"),
            F.lit("."),
            (F.col("event_id") % 254 + 1).cast("string"),
        ).alias("ip"),
        F.when(agent == 0, "bot")
        .when(agent == 1, "fraud")
        .when(agent == 2, "churning")
        .otherwise("normal")
        .alias("agent_type"),
        only("search", F.concat(F.lit("q"), k.cast("string"))).alias("query"),
        only("add_to_cart", k % 3 + 1).alias("quantity"),
        only("checkout", F.col("value")).alias("cart_total"),
        only("checkout", k % 5 + 1).alias("item_count"),
        only("payment", F.col("value")).alias("amount"),
        only("payment", F.lit("card")).alias("payment_method"),
        only(
            "user_signup",
            F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")),
        ).alias("email"),
        only("click", F.concat(F.lit("el_"), k.cast("string"))).alias("element_id"),
        only("product_view", F.col("value")).alias("price"),
        F.col("event_id").alias("arrival_seq"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_events`` cut into sessions by a 24 h idle gap per user."""
    cut = sessionize_gap(
        user_events(spark, sf_dir), "user_id", gap_seconds=SESSION_GAP_SECONDS
    )
    session = F.concat_ws("-", F.col("user_id"), F.col("segment").cast("string"))
    return cut.withColumn("session_id", session).drop("segment")


def envelope_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine envelope columns with the nested properties struct."""
    return session_events(spark, sf_dir).select(
        "event_id",
        "event_type",
        "timestamp",
        "session_id",
        "user_id",
        "url",
        "product_id",
        "status",
        F.struct("ip", "agent_type").alias("properties"),
    )


def full_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed field, with ``properties`` as an open map, for publishing."""
    events = session_events(spark, sf_dir)
    properties = F.create_map(
        F.lit("ip"), F.col("ip"), F.lit("agent_type"), F.col("agent_type")
    )
    wide = events.withColumn("properties", properties)
    return wide.select(*[f.name for f in FULL_EVENT.fields if f.name in wide.columns])


def raw_topic(spark: SparkSession, sf_dir: str, faults: bool = True) -> DataFrame:
    """Topic messages (key, value, seq, timestamp) of every event, some damaged by rule.

    Out of each fifty consecutive events one message each is empty, cut off,
    of an unknown type, without its user, and without its type's own fields.
    """
    events = full_events(spark, sf_dir).withColumn(
        "seq", F.col("event_id").cast("long")
    )
    rule = F.when(F.lit(faults), F.col("seq") % 50)
    damaged = events.withColumns(
        {
            "event_type": F.when(rule == 21, F.lit("hover")).otherwise(
                F.col("event_type")
            ),
            "key": F.col("user_id"),
            "user_id": F.when(rule == 29, F.lit(None)).otherwise(F.col("user_id")),
        }
        | {
            c: F.when(rule == 37, F.lit(None)).otherwise(F.col(c))
            for c in ("query", "product_id", "status", "item_count", "email", "element_id")
        }
    )
    body = [c for c in events.columns if c != "seq"]
    text = F.to_json(F.struct(*body), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    value = (
        F.when(rule == 7, F.lit(None))
        .when(rule == 13, F.substring(text, 1, 20))
        .otherwise(text)
    )
    message = F.struct("key", value.cast("binary").alias("value"), "seq", "timestamp")
    return damaged.select(computed_once(message))

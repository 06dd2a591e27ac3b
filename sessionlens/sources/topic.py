"""Message sources and the publish sinks, for a topic or for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlens.schema import TOPIC

MESSAGE_SCHEMA = "key string, value binary"
#: Bytes of a row group in published files: readers share a large file out by its row groups.
ROW_GROUP_BYTES = 4 << 20


def topic_options(
    servers: str, topic: str = TOPIC, starting: str = "latest", **extra: str
) -> dict[str, str]:
    """Connector options of a topic source; ``extra`` passes through."""
    if starting not in ("latest", "earliest"):
        raise ValueError("starting must be latest or earliest")
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        **extra,
    }


def read_topic(
    spark: SparkSession, servers: str, topic: str = TOPIC, starting: str = "latest", **extra: str
) -> DataFrame:
    """Stream of topic messages; needs the connector package on the class path."""
    options = topic_options(servers, topic, starting, **extra)
    return spark.readStream.format("kafka").options(**options).load()


def read_message_files(
    spark: SparkSession,
    path: str,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of (key, value) messages from parquet files put into a folder.

    A backlog is taken in batches of at most ``files_per_trigger`` files or about
    ``bytes_per_trigger`` bytes, one file at least.
    """
    if files_per_trigger and bytes_per_trigger:
        raise ValueError("limit a trigger by files or by bytes, not by both")
    reader = spark.readStream.schema(MESSAGE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(bytes_per_trigger))
    return reader.parquet(path)


def read_json_lines(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of messages from text files with one JSON event per line."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def publish_to_topic(messages: DataFrame, servers: str, topic: str = TOPIC, **extra: str) -> None:
    """Send (key, value) messages; producer batching options pass through."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, **extra}
    messages.write.format("kafka").options(**options).save()


def publish_to_files(messages: DataFrame, path: str, files: int, order: list[str]) -> None:
    """Write messages as ``files`` time slices, each in order.

    Slices are ranges of the order columns, so a busy user is spread over the
    slices of its time span while its messages stay in order. The ranges are found in a pass
    over the messages before they are dealt out: let costly messages be materialised.
    """
    sliced = messages.repartitionByRange(files, *order).sortWithinPartitions(*order)
    (
        sliced.select("key", "value")
        .write.mode("append")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(path)
    )

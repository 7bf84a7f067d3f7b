"""Message topics as streams: ``value`` (text) and ``timestamp`` (arrival)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_stream(
    spark: SparkSession,
    brokers: str,
    topic: str,
    from_beginning: bool = False,
    max_offsets: int | None = None,
    min_offsets: int | None = None,
    max_delay: str | None = None,
) -> DataFrame:
    """A Kafka topic. Needs Spark's Kafka package on the class path.

    ``max_offsets`` bounds the messages of one micro-batch over all partitions,
    so a start from the beginning does not read the whole topic at once.
    ``min_offsets`` waits for that many, but no longer than ``max_delay``.
    """
    options = topic_options(max_offsets, min_offsets, max_delay)
    if from_beginning:
        options["startingOffsets"] = "earliest"
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .options(**options)
    )
    return reader.load().select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp"
    )


def topic_options(
    max_offsets: int | None = None, min_offsets: int | None = None, max_delay: str | None = None
) -> dict[str, str]:
    if max_delay and not min_offsets:
        raise ValueError("a longest delay needs a least number of offsets to wait for")
    if max_offsets and min_offsets and min_offsets > max_offsets:
        raise ValueError("the least number of offsets exceeds the greatest")
    given = {"maxOffsetsPerTrigger": max_offsets, "minOffsetsPerTrigger": min_offsets, "maxTriggerDelay": max_delay}
    return {name: str(value) for name, value in given.items() if value}


def message_file_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, bytes_per_trigger: int | str | None = None
) -> DataFrame:
    """JSON-lines files as a topic: one message per line, arrival = file time.

    A micro-batch takes ``files_per_trigger`` files at most, or files of
    ``bytes_per_trigger`` (one at least, if that is larger).
    """
    if files_per_trigger and bytes_per_trigger:
        raise ValueError("files or bytes per trigger, not both")
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.load(path).select(
        "value", F.col("_metadata.file_modification_time").alias("timestamp")
    )

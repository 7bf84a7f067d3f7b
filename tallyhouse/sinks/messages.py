"""Rows to JSON messages, and message topics as sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyhouse.schemas import COLLECTION_SCHEMA

KEEP_NULLS = {"ignoreNullFields": "false"}
ASSET_FIELDS = ("asset_name", "asset_url", "image_url")


def encode_messages(rows: DataFrame, key_column: str | None = None) -> DataFrame:
    """``value`` holds the row as JSON, NULL fields included. A key column moves
    out of the object into ``key``."""
    fields = [c for c in rows.columns if c != key_column]
    value = F.to_json(F.struct(*fields), KEEP_NULLS).alias("value")
    if key_column is None:
        return rows.select(value)
    return rows.select(F.col(key_column).cast("string").alias("key"), value)


def decode_messages(messages: DataFrame, schema: str) -> DataFrame:
    parsed = F.from_json(F.col("value").cast("string"), schema)
    return messages.select(parsed.alias("row")).select("row.*")


def stored_rows(messages: DataFrame, key_column: str | None = None) -> DataFrame:
    """Messages ``value`` (and ``key``, if a column was taken out for it) as rows of the metric table.

    What cannot be a row keeps its text in ``message`` and says why in
    ``reason``. Asset rows of older writers have no key; it is made from what
    they show of the asset.
    """
    rows = messages.withColumn("row", F.from_json(F.col("value").cast("string"), COLLECTION_SCHEMA))
    fields = {f: F.col(f"row.{f}") for f in ("metric", "timestamp", "collection", "value", *ASSET_FIELDS, "asset_key")}
    if key_column:
        fields[key_column] = F.coalesce(fields[key_column], F.col("key").cast("string"))
    shown = F.to_json(F.struct(*(fields[f].alias(f) for f in ASSET_FIELDS)), KEEP_NULLS)
    of_asset = F.coalesce(*(fields[f] for f in ASSET_FIELDS)).isNotNull()
    fields["asset_key"] = F.coalesce(fields["asset_key"], F.when(of_asset, F.sha1(shown.cast("binary"))), F.lit(""))
    missing = [F.when(fields[f].isNull(), f"no {f}") for f in ("metric", "timestamp", "collection")]
    reason = F.coalesce(F.when(F.col("value").isNull(), "no message"), *missing)
    return rows.select(
        *(c.alias(f) for f, c in fields.items()),
        F.when(reason.isNotNull(), F.col("value").cast("string")).alias("message"),
        reason.alias("reason"),
    )


def write_topic(rows: DataFrame, topic: str, brokers: str, key_column: str | None = None) -> None:
    (
        encode_messages(rows, key_column)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("topic", topic)
        .save()
    )


def topic_writer(
    rows: DataFrame, topic: str, brokers: str, checkpoint: str, key_column: str | None = None
) -> DataStreamWriter:
    """Changed rows of each micro-batch to a topic."""
    if not topic:
        raise ValueError("a topic to write to is required")
    return (
        encode_messages(rows, key_column)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
    )


def console_writer(rows: DataFrame, checkpoint: str | None = None) -> DataStreamWriter:
    """The same messages to the console. The mode stays "update", so state
    behaves as it does with a topic behind it."""
    writer = (
        encode_messages(rows)
        .writeStream.format("console")
        .option("truncate", "false")
        .outputMode("update")
    )
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer

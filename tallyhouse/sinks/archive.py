"""Messages to hourly folders of gzipped JSON lines, and an index of what the hours hold.

Folders are named by arrival hour, and below it by the batch that wrote them, so
a repeated batch replaces its own files and nothing else. The index says, per
hour and batch, when its first and last event was sent and how many messages it
has. It is kept as a metric table of its own (``_index``; its readers list no
archive folder), and is written before the messages, so no message is missing
from it; what it says of a batch that never came is harmless.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyhouse.session import conf
from tallyhouse.sinks.store import compact_metrics, read_metrics, write_metrics

HOUR_COLUMNS = ["year", "month", "day", "hour"]
FOLDERS = [*HOUR_COLUMNS, "batch"]
INDEX = "_index"
#: What the index holds per hour and batch; times as microseconds since the epoch.
MEASURES = ("messages", "first_sent", "last_sent")


def sent_at() -> Column:
    """When a message says it was sent, read as cleaning does."""
    return F.from_json("value", "payload struct<sent_at: string>")["payload"]["sent_at"].try_cast("timestamp")


def write_archive(
    messages: DataFrame, path: str, max_records_per_file: int = 1_000_000, batch: str | None = None
) -> None:
    """Add messages to the folders of their arrival hours (UTC), as one batch.

    A batch of the same name is replaced hour by hour: repeated with the same
    messages it changes nothing. Rebalancing by hour first gives each hour few
    files however many tasks feed it, and splits an hour that is much larger
    than the others. The messages are read twice, for the index and the files.
    """
    batch = batch or uuid.uuid4().hex
    kept = messages.filter(F.col("value").isNotNull())
    _write_index(kept, path, batch)
    arrival = F.col("timestamp")
    hours = kept.select(
        "value",
        F.date_format(arrival, "yyyy").alias("year"),
        F.date_format(arrival, "MM").alias("month"),
        F.date_format(arrival, "dd").alias("day"),
        F.date_format(arrival, "HH").alias("hour"),
        F.lit(batch).alias("batch"),
    )
    with conf(messages.sparkSession, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        (
            hours.hint("rebalance", *HOUR_COLUMNS)
            .write.mode("overwrite")
            .partitionBy(*FOLDERS)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", max_records_per_file)
            .format("text")
            .save(path)
        )


def _write_index(messages: DataFrame, path: str, batch: str) -> None:
    sent = F.unix_micros(sent_at())
    hour = F.date_trunc("hour", F.coalesce("timestamp", F.lit("1970-01-01").cast("timestamp")))
    found = messages.groupBy(hour.alias("timestamp")).agg(
        F.count(F.lit(1)).alias("messages"), F.min(sent).alias("first_sent"), F.max(sent).alias("last_sent")
    )
    measures = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in MEASURES)))
    rows = found.select("timestamp", F.lit(batch).alias("collection"), measures.alias("m")).select("timestamp", "collection", "m.metric", "m.value")
    write_metrics(rows, f"{path.rstrip('/')}/{INDEX}", batch, spread=1)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, batch, messages, first_sent, last_sent): a row per arrival hour and batch."""
    rows = read_metrics(spark, f"{path.rstrip('/')}/{INDEX}")
    each = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in MEASURES]
    found = rows.groupBy("timestamp", F.col("collection").alias("batch")).agg(*each)
    times = [F.timestamp_micros(F.col(m).cast("long")).alias(m) for m in MEASURES[1:]]
    return found.select("timestamp", "batch", F.col("messages").cast("long").alias("messages"), *times)


def compact_index(spark: SparkSession, path: str) -> bool:
    return compact_metrics(spark, f"{path.rstrip('/')}/{INDEX}")


def archive_writer(messages: DataFrame, path: str, checkpoint: str, every: int = 200) -> DataStreamWriter:
    """The archive job: each micro-batch is one batch of the archive, named by query and number.

    A repeated micro-batch replaces its files. The index is compacted at every
    ``every``-th batch. How often files roll is the writer's trigger.
    """
    from tallyhouse.streaming.jobs import query_id

    names: list[str] = []

    def archive_batch(batch: DataFrame, number: int) -> None:
        if not names:
            names.append(query_id(batch.sparkSession, checkpoint))
        write_archive(batch, path, batch=f"{names[0]}-{number}")
        if number % every == every - 1:
            compact_index(batch.sparkSession, path)

    return (
        messages.writeStream.foreachBatch(archive_batch)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )

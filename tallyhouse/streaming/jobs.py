"""Streaming queries: clean once, aggregate once, write changed rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tallyhouse.functions.windows import event_window
from tallyhouse.operators import catalogue as C
from tallyhouse.operators.metrics import metric_stream
from tallyhouse.schemas import COLLECTION_COLUMNS, GLOBAL_COLUMNS
from tallyhouse.session import conf
from tallyhouse.sinks.messages import stored_rows
from tallyhouse.sinks.store import write_metrics

# State too large for the heap lives in RocksDB, and each batch uploads only
# its changes.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def global_stream(
    clean: DataFrame, grain: str, slide: str | None = None, watermark: str | None = None, **options
) -> DataFrame:
    rows = metric_stream(clean, [C.GLOBAL_WINDOWED], grain, slide, watermark, **options)
    return rows.select(*GLOBAL_COLUMNS)


def collections_stream(
    clean: DataFrame,
    grain: str,
    slide: str | None = None,
    watermark: str | None = None,
    with_asset_key: bool = False,
    **options,
) -> DataFrame:
    """Collection sales, collection transactions and asset transfers in one
    stateful aggregate. Rankings are taken on read of the stored rows."""
    families = [C.COLLECTION_SALES, C.COLLECTION_TRANSACTIONS, C.ASSET_TRANSFERS]
    rows = metric_stream(clean, families, grain, slide, watermark, **options)
    return rows.select(*COLLECTION_COLUMNS, *(["asset_key"] if with_asset_key else []))


def collection_counts(
    clean: DataFrame, grain: str, slide: str | None = None, watermark: str | None = None
) -> DataFrame:
    """Events per collection and (sliding) window."""
    if watermark:
        clean = clean.withWatermark("sent_at", watermark)
    return (
        clean.groupBy(event_window(grain, slide), "collection_slug")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "collection_slug",
            "count",
        )
    )


def checkpoint_path(base: str, query: str) -> str:
    """One fixed folder per query, so that a restart resumes where it stopped."""
    return f"{base.rstrip('/')}/{query}"


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint keeps for its query from its first start on."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def store_writer(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Changed rows of each micro-batch to the metric table.

    The writer's name is the query's id, which the checkpoint keeps: a retried
    batch overwrites its own folder, and no other query's.
    """

    names: list[str] = []

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        if not names:
            names.append(f"stream-{query_id(batch.sparkSession, checkpoint)}")
        write_metrics(batch, path, names[0], batch_id)

    return (
        rows.writeStream.foreachBatch(store_batch)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
    )


def messages_to_store(
    messages: DataFrame, path: str, checkpoint: str, key_column: str | None = None
) -> DataStreamWriter:
    """Messages of a metric topic (``value``, and ``key``) to the metric table.

    Each message is decoded once, and a micro-batch is one write: good rows and
    rejected messages are published together, once per query and batch.
    """
    return store_writer(stored_rows(messages, key_column), path, checkpoint)


def start(writer: DataStreamWriter, spark: SparkSession, state_partitions: int | None = None) -> StreamingQuery:
    """Start a query with the state settings; they are fixed at its first start."""
    settings = dict(STATE)
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    with conf(spark, settings):
        return writer.start()


def run_available(
    writer: DataStreamWriter,
    spark: SparkSession,
    state_partitions: int | None = None,
    timeout: int | None = None,
) -> None:
    """Process what the source holds now, then stop; raise after ``timeout`` seconds, if given."""
    query = start(writer.trigger(availableNow=True), spark, state_partitions)
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"stream still running after {timeout} s")
    finally:
        query.stop()


def wait_for_all(spark: SparkSession, queries: list[StreamingQuery]) -> None:
    """Wait until every query ends; a failed one stops the others and raises."""
    try:
        while any(query.isActive for query in queries):
            spark.streams.awaitAnyTermination()
            spark.streams.resetTerminated()
    finally:
        for query in queries:
            query.stop()

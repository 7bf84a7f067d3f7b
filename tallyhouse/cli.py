"""Command line: ``python -m tallyhouse {global,collections,all} GRAIN ...``."""

from __future__ import annotations

import argparse
import logging
import os
import time
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.functions.windows import ALL_TIME, BATCH_GRAINS, STREAM_GRAINS, grain_text
from tallyhouse.manage import add_stream_options, stream_source, triggered
from tallyhouse.operators.events import clean_messages
from tallyhouse.plans.jobs import read_clean_archive, run_batch
from tallyhouse.schemas import COLLECTION_COLUMNS, SALE_TYPES
from tallyhouse.session import get_session
from tallyhouse.sinks.clean_table import read_days
from tallyhouse.sinks.messages import console_writer, topic_writer, write_topic
from tallyhouse.sinks.store import write_metrics
from tallyhouse.sources.archive import parse_time
from tallyhouse.streaming.jobs import (
    checkpoint_path,
    collections_stream,
    global_stream,
    start,
    store_writer,
    wait_for_all,
)

log = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyhouse", description="Marketplace-event metrics.")
    p.add_argument("events_type", choices=["global", "collections", "all"])
    p.add_argument("time_window", type=str.lower, choices=[*BATCH_GRAINS, *STREAM_GRAINS])
    p.add_argument("--mode", choices=["batch", "stream"], help="default: by the grain")
    p.add_argument("--slide-duration", help="start a window this often (default: no overlap)")
    p.add_argument("--kafka-brokers")
    p.add_argument("--kafka-topic", help="where to write, for one events type")
    p.add_argument("--global-kafka-topic")
    p.add_argument("--collections-kafka-topic")
    p.add_argument("--global-store", help="folder of the global metric table")
    p.add_argument("--collections-store", help="folder of the collections metric table")
    p.add_argument("--debug", dest="debug_mode", action="store_true", help="write to the console")
    p.add_argument("--log-level", "-l", default="WARNING")
    p.add_argument("--master", default=os.environ.get("TALLYHOUSE_SPARK_MASTER"))
    p.add_argument("--max-cpu-cores", type=int)
    batch = p.add_argument_group("batch")
    batch.add_argument("--raw-events-s3-uri", help="folder of the raw message archive")
    batch.add_argument("--also", nargs="*", default=[], choices=BATCH_GRAINS, help="more grains from the same pass")
    batch.add_argument("--clean-events", help="folder of landed clean events, in place of the archive")
    batch.add_argument("--sale-types", nargs="+", default=list(SALE_TYPES), help="event types that count as sales")
    batch.add_argument("--timestamp-start", type=parse_time)
    batch.add_argument("--timestamp-end", type=parse_time)
    stream = p.add_argument_group("stream")
    stream.add_argument("--raw-events-kafka-topic")
    stream.add_argument("--raw-events-files", help="folder of message files, in place of a topic")
    stream.add_argument("--watermark-duration")
    stream.add_argument("--checkpoint-dir")
    stream.add_argument("--state-partitions", type=int)
    add_stream_options(stream)
    return p


def mode_of(args: argparse.Namespace) -> str:
    if args.time_window == ALL_TIME and args.mode == "stream":
        raise ValueError("all-time metrics are computed in batch only")
    return args.mode or ("batch" if args.time_window in BATCH_GRAINS else "stream")


def _feeds(args: argparse.Namespace) -> list[str]:
    return ["global", "collections"] if args.events_type == "all" else [args.events_type]


def _topic(args: argparse.Namespace, feed: str) -> str | None:
    own = args.global_kafka_topic if feed == "global" else args.collections_kafka_topic
    return own if args.events_type == "all" else args.kafka_topic or own


def _store(args: argparse.Namespace, feed: str) -> str | None:
    return args.global_store if feed == "global" else args.collections_store


def _batch_writer(args: argparse.Namespace, feed: str, run: str):
    """The feed's sink: the metric table, a topic, or a count only."""
    if store := _store(args, feed):
        batches = count()

        def to_store(rows: DataFrame) -> None:
            write_metrics(rows, store, run, next(batches))

        return to_store
    if topic := _topic(args, feed):
        if not args.kafka_brokers:
            raise ValueError("--kafka-brokers is required to write to a topic")

        def to_topic(rows: DataFrame) -> None:
            write_topic(rows, topic, args.kafka_brokers)

        return to_topic

    def to_nowhere(rows: DataFrame) -> None:
        rows.write.format("noop").mode("overwrite").save()

    return to_nowhere


def batch(args: argparse.Namespace, spark: SparkSession) -> dict[str, int]:
    if not args.raw_events_s3_uri and not args.clean_events:
        raise ValueError("--raw-events-s3-uri or --clean-events is required in batch")
    # A run has one folder per grain in the table, numbered like stream batches.
    run = f"batch-{uuid.uuid4().hex}"
    writers = {f"write_{feed}": _batch_writer(args, feed, run) for feed in _feeds(args)}
    if args.clean_events:
        clean = read_days(spark, args.clean_events, args.timestamp_start, args.timestamp_end)
    else:
        clean = read_clean_archive(spark, args.raw_events_s3_uri, args.timestamp_start, args.timestamp_end)
    grains = list(dict.fromkeys([args.time_window, *args.also]))
    landed = bool(args.clean_events)
    return run_batch(clean, grains, args.slide_duration, sale_types=tuple(args.sale_types), landed=landed, **writers)


def _stream_writer(args: argparse.Namespace, feed: str, rows: DataFrame):
    name = f"{feed}-{grain_text(args.time_window)}"
    checkpoint = checkpoint_path(args.checkpoint_dir, name)
    if args.debug_mode:
        shown = rows.select(*[c for c in rows.columns if c in COLLECTION_COLUMNS])
        return console_writer(shown, checkpoint)
    if store := _store(args, feed):
        return store_writer(rows, store, checkpoint)
    topic = _topic(args, feed)
    if topic and not args.kafka_brokers:
        raise ValueError("--kafka-brokers is required to write to a topic")
    return topic_writer(rows, topic, args.kafka_brokers, checkpoint)


def stream(args: argparse.Namespace, spark: SparkSession) -> None:
    if not args.checkpoint_dir:
        raise ValueError("--checkpoint-dir is required in stream mode")
    clean = clean_messages(stream_source(spark, args, args.raw_events_kafka_topic, args.raw_events_files))
    options = (args.time_window, args.slide_duration, args.watermark_duration)
    queries = []
    for feed in _feeds(args):
        if feed == "global":
            rows = global_stream(clean, *options)
        else:
            rows = collections_stream(clean, *options, with_asset_key=True)
        writer = triggered(_stream_writer(args, feed, rows), args)
        queries.append(start(writer, spark, args.state_partitions))
    wait_for_all(spark, queries)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level)
    began = time.time()
    mode = mode_of(args)
    spark = get_session(master=args.master, cores_max=args.max_cpu_cores)
    (batch if mode == "batch" else stream)(args, spark)
    log.info("%s run took %.2f seconds", mode, time.time() - began)

"""Command line for stored tables: ``python -m tallyhouse.manage {archive,fill,land,compact,read} ...``."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.plans.jobs import land_days
from tallyhouse.schemas import COLLECTION_COLUMNS
from tallyhouse.serving import reads
from tallyhouse.session import get_session, use_utc
from tallyhouse.sinks.archive import INDEX, archive_writer
from tallyhouse.sinks.store import compact_metrics, read_metrics, read_rejects
from tallyhouse.sources.archive import has_index, parse_time
from tallyhouse.sources.topics import message_file_stream, topic_stream
from tallyhouse.streaming.jobs import messages_to_store, start, wait_for_all


def add_stream_options(p: argparse.ArgumentParser) -> None:
    """Where messages come from, and how much of them a micro-batch takes."""
    p.add_argument("--trigger", help="start a micro-batch this often, as '1 minute' (default: at once)")
    p.add_argument("--available-now", action="store_true", help="stop when the source is drained")
    p.add_argument("--start-from-beginning", action="store_true")
    p.add_argument("--max-offsets-per-trigger", type=int, help="topic messages of a micro-batch at most")
    p.add_argument("--min-offsets-per-trigger", type=int, help="wait for so many topic messages")
    p.add_argument("--max-trigger-delay", help="but no longer than this")
    p.add_argument("--files-per-trigger", type=int)
    p.add_argument("--bytes-per-trigger", help="message files of a micro-batch at most, as 10g")


def stream_source(spark: SparkSession, args: argparse.Namespace, topic: str | None, files: str | None) -> DataFrame:
    if files:
        return message_file_stream(spark, files, args.files_per_trigger, args.bytes_per_trigger)
    if topic and args.kafka_brokers:
        return topic_stream(
            spark,
            args.kafka_brokers,
            topic,
            args.start_from_beginning,
            args.max_offsets_per_trigger,
            args.min_offsets_per_trigger,
            args.max_trigger_delay,
        )
    raise ValueError("a topic with --kafka-brokers, or message files, are required")


def triggered(writer, args: argparse.Namespace):
    if args.available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=args.trigger) if args.trigger else writer


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyhouse.manage", description=__doc__)
    p.add_argument("--master", default=os.environ.get("TALLYHOUSE_SPARK_MASTER"))
    p.add_argument("--log-level", "-l", default="WARNING")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, run) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        c.set_defaults(run=run)
        return c

    for name, text, run in (
        ("archive", "messages of a topic to hourly folders", archive),
        ("fill", "metric messages of a topic to a metric table", fill),
    ):
        c = command(name, text, run)
        c.add_argument("--kafka-brokers")
        c.add_argument("--kafka-topic")
        c.add_argument("--files", help="folder of message files, in place of a topic")
        c.add_argument("--checkpoint-dir", required=True)
        c.add_argument("--path", required=True, help="folder of the archive or table")
        if name == "fill":
            c.add_argument("--key-column", help="the column that messages have as their key")
        add_stream_options(c)
    c = command("land", "clean events of an archive, replaced day by day", land_archive)
    c.add_argument("--raw-events-s3-uri", required=True)
    c.add_argument("--path", required=True)
    c.add_argument("--timestamp-start", type=parse_time)
    c.add_argument("--timestamp-end", type=parse_time)
    c = command("compact", "merge a metric table's small folders, or those of an archive's index", compact)
    c.add_argument("--path", required=True)
    c.add_argument("--everything", action="store_true", help="the whole table to one folder")
    c = command("read", "rows of a metric table as JSON lines", read)
    c.add_argument("--path", required=True)
    c.add_argument("--collection")
    c.add_argument("--metric")
    c.add_argument("--grain")
    c.add_argument("--timestamp-start", type=parse_time)
    c.add_argument("--timestamp-end", type=parse_time)
    c.add_argument("--limit", type=int)
    c.add_argument("--order", choices=["ascending", "descending"], help="by time")
    c.add_argument("--rejects", action="store_true", help="the rows that the table refused")
    return p


def archive(args: argparse.Namespace, spark: SparkSession) -> None:
    messages = stream_source(spark, args, args.kafka_topic, args.files).select("value", "timestamp")
    wait_for_all(spark, [start(triggered(archive_writer(messages, args.path, args.checkpoint_dir), args), spark)])


def fill(args: argparse.Namespace, spark: SparkSession) -> None:
    messages = stream_source(spark, args, args.kafka_topic, args.files)
    writer = messages_to_store(messages, args.path, args.checkpoint_dir, args.key_column)
    wait_for_all(spark, [start(triggered(writer, args), spark)])


def land_archive(args: argparse.Namespace, spark: SparkSession) -> None:
    land_days(spark, args.raw_events_s3_uri, args.path, args.timestamp_start, args.timestamp_end)


def compact(args: argparse.Namespace, spark: SparkSession) -> None:
    path = f"{args.path.rstrip('/')}/{INDEX}" if has_index(spark, args.path) else args.path
    compact_metrics(spark, path, args.everything)


def rows_of(args: argparse.Namespace, spark: SparkSession) -> DataFrame:
    if args.rejects:
        return read_rejects(spark, args.path)
    ascending = None if args.order is None else args.order == "ascending"
    rows = read_metrics(spark, args.path)
    cut = (args.timestamp_start, args.timestamp_end, args.limit, ascending)
    if args.collection:
        return reads.read_collection(rows, args.collection, args.metric, args.grain, *cut).select(*COLLECTION_COLUMNS)
    return reads.read_global(rows, args.metric, args.grain, *cut).select(*COLLECTION_COLUMNS)


def read(args: argparse.Namespace, spark: SparkSession) -> None:
    for line in rows_of(args, spark).toJSON().toLocalIterator():
        print(line)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level)
    spark = get_session(master=args.master)
    use_utc(spark)
    args.run(args, spark)


if __name__ == "__main__":
    main()

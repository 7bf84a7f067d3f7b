"""Batch scan of the raw message archive and time-range reads."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.windows import time_literal
from tallyhouse.schemas import RAW_SCHEMA
from tallyhouse.sinks.archive import INDEX, read_index
from tallyhouse.sinks.snapshots import LIST, Storage

FOLDER_TYPES = "year int, month int, day int, hour int, batch string"


def read_archive(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    skew: timedelta | None = None,
    lateness: timedelta | None = None,
) -> DataFrame:
    """Raw events below ``year=/month=/day=/hour=`` folders of gzipped JSON lines.

    A range is of event time (``sent_at``), folders are named by arrival hour,
    and an event may arrive at any time after it is sent (outages, replays), or
    before by a clock that is ahead. An archive with an index (``sinks.archive``
    keeps one) says which hours hold events of the range: those folders alone
    are listed and read. Without an index all are, unless the caller states how
    far clocks differ (``skew``, cuts folders before ``start``) or how late
    events can be (``lateness``, cuts folders after ``end``).
    The exact cut on ``sent_at`` is ``in_time_range``, after cleaning.
    """
    reader = spark.read.schema(f"{RAW_SCHEMA}, {FOLDER_TYPES}")
    if (start or end) and has_index(spark, path):
        folders = folders_in_range(spark, path, start, end)
        if not folders:
            return spark.createDataFrame([], f"{RAW_SCHEMA}, {FOLDER_TYPES}").drop("batch")
        return reader.option("basePath", path).json(folders).drop("batch")
    raw = reader.json(path).drop("batch")
    if start and skew is not None:
        raw = raw.filter(_folder_hour() >= _hour_number(start - skew))
    if end and lateness is not None:
        raw = raw.filter(_folder_hour() <= _hour_number(end + lateness))
    return raw


def has_index(spark: SparkSession, path: str) -> bool:
    return bool(Storage(spark, path).names(f"{INDEX}/{LIST}"))


def folders_in_range(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None
) -> list[str]:
    """Folders that the index says hold events sent within ``[start, end]``; those alone come to the driver."""
    hours = read_index(spark, path)
    if start:
        hours = hours.filter(F.col("last_sent") >= time_literal(start))
    if end:
        hours = hours.filter(F.col("first_sent") <= time_literal(end))
    name = F.concat(F.date_format("timestamp", "'year='yyyy'/month='MM'/day='dd'/hour='HH"), F.lit("/batch="), "batch")
    found = [row[0] for row in hours.filter("last_sent is not null").select(name).distinct().orderBy(name).collect()]
    storage = Storage(spark, path)
    return [f"{path.rstrip('/')}/{folder}" for folder in found if storage.exists(folder)]


def read_message_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw events from plain JSON-lines files."""
    return spark.read.schema(RAW_SCHEMA).json(path)


def parse_time(text: str) -> datetime:
    """``YYYY-MM-DD`` or ``YYYY-MM-DDTHH:MM:SS``, without a zone (UTC is meant)."""
    for pattern in ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S"):
        try:
            return datetime.strptime(text, pattern)
        except ValueError:
            continue
    raise ValueError(f"not a date or a date and time: {text!r}")


def in_time_range(clean: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Events sent within ``[start, end]``, both ends included."""
    if start:
        clean = clean.filter(F.col("sent_at") >= time_literal(start))
    if end:
        clean = clean.filter(F.col("sent_at") <= time_literal(end))
    return clean


def _folder_hour() -> Column:
    """Partition columns as one ordered number, so the filter prunes folders."""
    return ((F.col("year") * 100 + F.col("month")) * 100 + F.col("day")) * 100 + F.col("hour")


def _hour_number(moment: datetime) -> int:
    if moment.tzinfo:
        moment = moment.astimezone(timezone.utc)
    return int(moment.strftime("%Y%m%d%H"))

"""Clean events landed as Parquet, for plans that read them more than once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.events import is_sale, is_transfer
from tallyhouse.functions.windows import time_literal
from tallyhouse.schemas import CLEAN_COLUMNS, CLEAN_FIELDS
from tallyhouse.session import conf
from tallyhouse.sinks.snapshots import Storage
from tallyhouse.sources.archive import in_time_range

SCHEMA = ", ".join(["event string", *[f"{name} {kind}" for name, (_, kind) in CLEAN_FIELDS.items()]])
DAY = "event_date"
FOLDERS = [DAY, "kind"]


def write_clean(clean: DataFrame, path: str) -> None:
    """A table to keep. Folders by day and kind (sale, transfer, other; event
    types have no bound): a sales plan and a transfers plan then read disjoint
    row groups, and a time range reads its days only. Rebalancing gives each folder few files and splits a large one."""
    (
        clean.withColumn("event_date", F.to_date("sent_at"))
        .withColumn("kind", _kind())
        .hint("rebalance", *FOLDERS)
        .write.mode("overwrite")
        .partitionBy(*FOLDERS)
        .parquet(path)
    )


def write_days(clean: DataFrame, path: str, start: datetime | None = None, end: datetime | None = None) -> None:
    """Add events to a kept table, or replace them: a day's folder at a time.

    Each day that has events is replaced whole, as one folder, when the job
    commits. Days inside ``start`` to ``end`` that have none any more are
    deleted then. So a range must be whole days, and a repeated run changes
    nothing. Inside a day rows are sorted by kind and collection, so a sales
    plan skips the row groups of transfers.
    """
    if any(t and (t.hour, t.minute, t.second, t.microsecond) != (0, 0, 0, 0) for t in (start, end)):
        raise ValueError("events are landed by whole days: give dates")
    spark = clean.sparkSession
    if end:
        clean = clean.filter(F.col("sent_at") < time_literal(end))
    days = clean.withColumn(DAY, F.to_date("sent_at")).withColumn("kind", _kind())
    with conf(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        (
            days.hint("rebalance", DAY)
            .sortWithinPartitions(DAY, "kind", "collection_slug", "sent_at")
            .drop("kind")
            .write.mode("overwrite")
            .partitionBy(DAY)
            .parquet(path)
        )
    if start and end:
        storage = Storage(spark, path)
        inside = {f"{DAY}={start.date() + timedelta(days=i)}" for i in range((end - start).days)}
        there = inside & set(storage.names(""))
        kept = {f"{DAY}={r[0]}" for r in days.select(DAY).distinct().collect()} if there else set()
        for name in there - kept:
            storage.delete(name)


def read_days(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Events of a kept table; a time range (both ends included) reads its days only."""
    rows = spark.read.schema(f"{SCHEMA}, {DAY} date").parquet(path)
    if start:
        rows = rows.filter(F.col(DAY) >= F.lit(start.date()))
    if end:
        rows = rows.filter(F.col(DAY) <= F.lit(end.date()))
    return in_time_range(rows.select(*CLEAN_COLUMNS), start, end)


def write_clean_in_place(clean: DataFrame, path: str) -> None:
    """A copy for one run. Each task writes what it parsed, one file per
    kind, so the whole input is not shuffled for it."""
    clean.withColumn("kind", _kind()).write.partitionBy("kind").parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """Clean events as they were landed. Types are stated, so a table without
    rows reads as one; values are data and never folder names."""
    return spark.read.schema(SCHEMA).parquet(path).select(*CLEAN_COLUMNS)


def _kind() -> Column:
    return F.when(is_sale(), "sale").when(is_transfer(), "transfer").otherwise("other")

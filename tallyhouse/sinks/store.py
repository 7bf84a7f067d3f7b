"""The metric table: keyed rows, last write wins.

Every write is a folder of its own, published when it is whole
(``sinks.snapshots``); a repeated batch of one writer replaces the one before.
No two writers share a name (a stream's is the id in its checkpoint). Rows carry
the time of their write, and reading keeps the row written last per key, whether
a stream or a batch run wrote it.

Inside a metric's folder rows are sorted by collection and time, and compaction
deals them into files by ranges of these, so a read of one metric opens that
metric's files only, and one collection or time range few of their row groups.
"""

from __future__ import annotations

import threading
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhouse.schemas import COLLECTION_SCHEMA
from tallyhouse.sinks.snapshots import COMPACTED, DATA, SnapshotList, Write, data_folder

STORED_SCHEMA = COLLECTION_SCHEMA
KEY = ["metric", "collection", "timestamp", "asset_key"]
#: Columns of the files besides the stored ones: the writer, and why a row was rejected.
WRITTEN = "written bigint, run string, batch bigint"
REJECTED = "message string, reason string"
FOLDERS = ["kept", "metric"]
IN_FILE = ["collection", "timestamp", "asset_key"]


_clock = threading.Lock()
_last = 0


def _now() -> int:
    """Nanoseconds; later calls of this process get larger numbers."""
    global _last
    with _clock:
        _last = max(time.time_ns(), _last + 1)
        return _last


def write_metrics(rows: DataFrame, path: str, run: int | str, batch: int = 0, spread: int = 16) -> int:
    """Store one batch of metric rows as the writer ``run``; gives how many.

    Rows whose key has a NULL cannot be addressed; they land under
    ``kept=false`` and reads of the table do not see them. So do rows with a
    ``reason`` (and the ``message`` they came from), if there is such a column.
    """
    mark = Write(str(run), int(batch), _now())
    seen = Observation()
    stored = (
        _stored_columns(rows)
        .withColumns({"written": F.lit(mark.written), "run": F.lit(mark.writer), "batch": F.lit(mark.batch).cast("long")})
        .withColumn("reason", F.coalesce("reason", F.when(~_has_key(), "a key column is null")))
        .withColumn("kept", F.col("reason").isNull())
        .withColumn("_part", F.pmod(F.xxhash64("collection", "asset_key"), F.lit(spread)))
        .observe(seen, F.count(F.lit(1)).alias("rows"))
        .hint("rebalance", "metric", "_part")
        .drop("_part")
    )
    snapshots = SnapshotList(rows.sparkSession, path)
    _write_files(stored, f"{path.rstrip('/')}/{mark.folder}")
    count = _counted(seen)
    if count:
        snapshots.add(Write(mark.writer, mark.batch, mark.written, count))
    else:
        snapshots.storage.delete(mark.folder)
    return count


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every key, as the table is now. Filters on key columns reach the files."""
    state = SnapshotList(spark, path).state()
    rows = _read(spark, path, state.folders).filter("kept")
    # A compacted folder has one row per key.
    rows = rows if len(state.snapshot.folders) == 1 and not state.writes else latest(rows)
    return rows.select(*_names(STORED_SCHEMA))


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return _read_all(spark, path).filter("not kept").select(*_names(STORED_SCHEMA), *_names(REJECTED))


def latest(rows: DataFrame) -> DataFrame:
    newest_first = W.partitionBy(*KEY).orderBy(F.desc("written"), F.desc("run"), F.desc("batch"))
    return (
        rows.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def compact_metrics(spark: SparkSession, path: str, everything: bool = False) -> bool:
    """Merge the table's small folders into one, while others read and write; True if there was something.

    All writes since the last compaction are merged, and compacted folders that
    are not over twice as large as what is merged already; so a row is rewritten
    a number of times that grows with the logarithm of the table. With
    ``everything`` the whole table becomes one folder.
    """
    snapshots = SnapshotList(spark, path)
    before = snapshots.state()
    kept = dict(sorted(before.snapshot.folders.items(), key=lambda f: -f[1]))
    merged, size = [], sum(w.rows for w in before.writes)
    while kept and (everything or next(reversed(kept.values())) <= 2 * size):
        folder, rows = kept.popitem()
        merged.append(folder)
        size += rows
    if not before.writes and len(merged) < 2:
        return False
    number = before.snapshot.number + 1
    snapshots.claim(number)
    target = data_folder(COMPACTED, number, _now())
    try:
        seen = Observation()
        rows = _read(spark, path, [*merged, *(w.folder for w in before.writes)])
        newest = latest(rows.filter("kept")).unionByName(rows.filter("not kept"))
        ranges = newest.observe(seen, F.count(F.lit(1)).alias("rows")).repartitionByRange(*FOLDERS, *IN_FILE)
        _write_files(ranges, f"{path.rstrip('/')}/{target}")
        snapshots.publish(before, kept | {target: _counted(seen)}, before.writes, merged)
    except BaseException:
        snapshots.give_up(number)
        raise
    return True


def _write_files(rows: DataFrame, folder: str) -> None:
    rows.sortWithinPartitions(*FOLDERS, *IN_FILE).write.partitionBy(*FOLDERS).parquet(folder)


def _counted(seen: Observation) -> int:
    try:
        return seen.get["rows"]
    except Py4JJavaError:  # the plan turned out to be empty, and the count was dropped with it
        return 0


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    # The stored types are stated: folder names would be guessed at otherwise.
    schema, root = f"{STORED_SCHEMA}, {REJECTED}, {WRITTEN}, kept boolean", path.rstrip("/")
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(f"{schema}, writer string, write string").option("basePath", f"{root}/{DATA}")
    return reader.parquet(*(f"{root}/{f}" for f in folders)).drop("writer", "write")


def _read_all(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, SnapshotList(spark, path).state().folders)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _stored_columns(rows: DataFrame) -> DataFrame:
    """Fill the columns a narrower feed lacks, in the stored types."""
    columns = []
    for field in f"{STORED_SCHEMA}, {REJECTED}".split(", "):
        name, kind = field.split()
        if name in rows.columns:
            column = F.col(name).cast(kind)
        else:
            column = F.lit("" if name == "asset_key" else None).cast(kind)
        columns.append(column.alias(name))
    return rows.select(*columns)


def _has_key() -> Column:
    test = F.lit(True)
    for name in KEY:
        test = test & F.col(name).isNotNull()
    return test

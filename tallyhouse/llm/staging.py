"""Staged tables in the shared folder, and the package's code on the executors."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyhouse.session import conf, scratch_dir

#: A staged table cuts the lineage, so the shuffle files behind it are not needed again.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: So many texts at a time go to a worker and come back, whatever their number in a task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver has it from."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def tidy(run):
    """A function for ``mapInArrow`` whose worker gives freed memory back when a task ends: it lives on, beside the next operators."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Memory that Arrow and the C library hold free goes to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Stage:
    """Scratch tables of one operator run, under one folder of ``spark.checkpoint.dir``.

    Written as Parquet, so later steps read them again if an executor is lost.
    ``drop`` deletes one that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark, self.base, self.count = spark, scratch_dir(spark, label), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        with conf(self.spark, TIDY):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(
    app_name: str = "tallyhouse",
    master: str | None = None,
    cores_max: int | None = None,
    log_level: str = "WARN",
    config: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if cores_max:
        builder = builder.config("spark.cores.max", str(cores_max))
    for key, value in {**DEFAULTS, **(config or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(log_level)
    return spark


def use_utc(spark: SparkSession) -> None:
    """Windows are cut on UTC instants, so text and NTZ times must mean UTC too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder on storage that every executor sees.

    The cluster names it in ``spark.checkpoint.dir``; there is no other place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_space(spark: SparkSession, label: str) -> Iterator[str]:
    """A scratch folder that is deleted at the end of the block."""
    path = scratch_dir(spark, label)
    try:
        yield path
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write once to shared storage and read back, cutting the lineage.

    Used where several plans read the same expensive input; the Parquet copy
    keeps column pruning and filter pushdown, and survives lost executors.
    """
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Set session options for the length of a block."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)

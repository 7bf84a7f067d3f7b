"""Batch runs: read the archive, compute the feeds of one grain, write them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.events import clean_events
from tallyhouse.plans.families import collections_feed, global_feed
from tallyhouse.plans.rollup import asset_chain, common_base, partial_groups
from tallyhouse.schemas import SALE_TYPES
from tallyhouse.session import materialise, scratch_space
from tallyhouse.sinks.clean_table import read_clean, write_clean_in_place, write_days
from tallyhouse.sources.archive import in_time_range, read_archive

log = logging.getLogger(__name__)
Writer = Callable[[DataFrame], None]


def read_clean_archive(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    return in_time_range(clean_events(read_archive(spark, path, start, end)), start, end)


def land_days(
    spark: SparkSession, archive: str, path: str, start: datetime | None = None, end: datetime | None = None
) -> None:
    """Clean events of an archive, or of a time range of it, to a kept table, replaced day by day."""
    write_days(read_clean_archive(spark, archive, start, end), path, start, end)


def land(clean: DataFrame, path: str) -> DataFrame:
    """Clean events parsed once and kept as Parquet for the plans that follow."""
    write_clean_in_place(clean, path)
    return read_clean(clean.sparkSession, path)


def write_counted(rows: DataFrame, write: Writer, name: str) -> int:
    """Write once, counting rows on the way instead of in a second run."""
    seen = Observation(name)
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
    count = seen.get["rows"]
    log.info("wrote %d %s rows", count, name)
    return count


def run_batch(
    clean: DataFrame,
    grains: Sequence[str],
    slide: str | None = None,
    write_global: Writer | None = None,
    write_collections: Writer | None = None,
    as_of: datetime | None = None,
    sale_types: Sequence[str] = SALE_TYPES,
    landed: bool = False,
) -> dict[str, int]:
    """Compute and write the asked-for feeds of the given grains.

    One global feed reads its input once. More than that reads it several
    times, so raw input is landed first, unless partial groups are all that is
    needed of it, or ``landed`` says it is. Several grains share partial groups.
    """
    counts = {}
    partials = None
    with scratch_space(clean.sparkSession, "batch") as scratch:
        if write_collections and not landed:
            clean = land(clean, f"{scratch}/clean")
        assets: dict[str, DataFrame] = {}
        if len(grains) > 1:
            base = common_base(grains, slide)
            partials = materialise(partial_groups(clean, base), f"{scratch}/partials")
            if write_collections:
                assets = asset_chain(clean, grains, f"{scratch}/assets", slide)
        options = {"as_of": as_of, "partials": partials, "sale_types": sale_types}
        for grain in grains:
            if write_global:
                feed = global_feed(clean, grain, slide, **options)
                counts[f"global {grain}"] = write_counted(feed, write_global, f"global {grain}")
            if write_collections:
                feed = collections_feed(clean, grain, slide, with_asset_key=True, asset_partials=assets.get(grain), **options)
                counts[f"collections {grain}"] = write_counted(feed, write_collections, f"collections {grain}")
    return counts

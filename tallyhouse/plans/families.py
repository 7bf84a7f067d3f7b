"""Batch metric families, one function each, and the feeds that combine them."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.windows import ALL_TIME, metric_name, run_time
from tallyhouse.operators import catalogue as C
from tallyhouse.operators.explore import top_sales_by_price
from tallyhouse.operators.metrics import metric_rows
from tallyhouse.schemas import COLLECTION_COLUMNS, GLOBAL_COLUMNS


def _global(clean, families, grain=ALL_TIME, **options) -> DataFrame:
    return metric_rows(clean, families, grain, **options).select(*GLOBAL_COLUMNS)


def _collections(clean, families, grain=ALL_TIME, with_asset_key=False, **options) -> DataFrame:
    keep = [*COLLECTION_COLUMNS, "asset_key"] if with_asset_key else COLLECTION_COLUMNS
    return metric_rows(clean, families, grain, **options).select(*keep)


def global_metrics(clean: DataFrame, grain: str, slide: str | None = None, **options) -> DataFrame:
    """Events, transfers, items, sales and volumes per window; missing sums are 0."""
    return _global(clean, [C.GLOBAL_WINDOWED], grain, slide=slide, **options)


def global_all_time(clean: DataFrame, as_of: datetime | None = None, **options) -> DataFrame:
    return _global(clean, [C.GLOBAL_ALL_TIME], as_of=as_of, **options)


def top_collections_by_sales(clean: DataFrame, grain: str, slide: str | None = None, **options) -> DataFrame:
    return _global(clean, [C.TOP_COLLECTIONS_BY_SALES], grain, slide=slide, **options)


def top_collections_by_transfers(clean: DataFrame, grain: str, slide: str | None = None, **options) -> DataFrame:
    return _global(clean, [C.TOP_COLLECTIONS_BY_TRANSFERS], grain, slide=slide, **options)


def top_collections_all_time(clean: DataFrame, n: int = 10, as_of: datetime | None = None, **options) -> DataFrame:
    """Top n by volume and top n by transfers, from one aggregate per collection."""
    families = [
        replace(C.TOP_COLLECTIONS_BY_SALES_ALL_TIME, top_n=n),
        replace(C.TOP_COLLECTIONS_BY_TRANSFERS_ALL_TIME, top_n=n),
    ]
    return _global(clean, families, as_of=as_of, **options)


def collection_sales(clean: DataFrame, grain: str, slide: str | None = None, **options) -> DataFrame:
    return _collections(clean, [C.COLLECTION_SALES], grain, slide=slide, **options)


def collection_transactions(clean: DataFrame, grain: str, slide: str | None = None, **options) -> DataFrame:
    return _collections(clean, [C.COLLECTION_TRANSACTIONS], grain, slide=slide, **options)


def collection_all_time(clean: DataFrame, as_of: datetime | None = None, **options) -> DataFrame:
    """Transfer and sales sides of every collection; a missing side stays NULL.

    One conditional aggregate gives what a full outer join of two would.
    """
    return _collections(clean, [C.COLLECTION_ALL_TIME], as_of=as_of, **options)


def asset_transfers(clean: DataFrame, grain: str, slide: str | None = None, **options) -> DataFrame:
    """Every asset's transfer count per window, unranked."""
    return _collections(clean, [C.ASSET_TRANSFERS], grain, slide=slide, **options)


def top_assets_by_sales(clean: DataFrame, grain: str, slide: str | None = None, n: int = 20, **options) -> DataFrame:
    return _collections(clean, [replace(C.TOP_ASSETS_BY_SALES, top_n=n)], grain, slide=slide, **options)


def top_assets_by_transfers(
    clean: DataFrame, grain: str, slide: str | None = None, n: int = 20, **options
) -> DataFrame:
    return _collections(clean, [replace(C.TOP_ASSETS_BY_TRANSFERS, top_n=n)], grain, slide=slide, **options)


def top_assets_all_time(
    clean: DataFrame, n_per_collection: int = 20, as_of: datetime | None = None, **options
) -> DataFrame:
    families = [
        replace(C.TOP_ASSETS_BY_SALES_ALL_TIME, top_n=n_per_collection),
        replace(C.TOP_ASSETS_BY_TRANSFERS_ALL_TIME, top_n=n_per_collection),
    ]
    return _collections(clean, families, as_of=as_of, **options)


def exploration_metrics(clean: DataFrame, grain: str, slide: str | None = None, **options) -> DataFrame:
    """What explorations chart, with the global totals, from one scan: volume and
    top collections by sold items, transfers and items per window."""
    families = [C.GLOBAL_WINDOWED, C.TOTAL_VOLUME, C.TRANSFER_TOTALS, C.TOP_COLLECTIONS_BY_VOLUME]
    return _global(clean, families, grain, slide=slide, **options)


def collection_profile(clean: DataFrame, grain: str, n: int = 20, **options) -> DataFrame:
    """Price statistics of each collection and window, and its ``n`` dearest sales."""
    stats = _collections(clean, [C.COLLECTION_STATS], grain, **options).filter(F.col("collection").isNotNull())
    return stats.unionByName(top_sales_by_price(clean, grain, n))


def _merged(clean: DataFrame, partials: DataFrame | None) -> tuple[DataFrame, dict]:
    """The rows to build non-asset metrics from, and how to read them."""
    return (clean, {}) if partials is None else (partials, {"from_partials": True})


def global_feed(
    clean: DataFrame,
    grain: str,
    slide: str | None = None,
    as_of: datetime | None = None,
    partials: DataFrame | None = None,
    **options,
) -> DataFrame:
    """All global-level metrics of one grain in one scan, of the events or, if
    given, of the partial groups made from them (``plans.rollup``)."""
    source, how = _merged(clean, partials)
    options.update(how)
    if grain != ALL_TIME:
        families = [C.GLOBAL_WINDOWED, C.TOP_COLLECTIONS_BY_SALES, C.TOP_COLLECTIONS_BY_TRANSFERS]
        return _global(source, families, grain, slide=slide, **options)
    families = [
        C.GLOBAL_ALL_TIME,
        C.TOP_COLLECTIONS_BY_SALES_ALL_TIME,
        C.TOP_COLLECTIONS_BY_TRANSFERS_ALL_TIME,
    ]
    return _with_empty_totals(_global(source, families, as_of=as_of, **options), as_of)


def collections_feed(
    clean: DataFrame,
    grain: str,
    slide: str | None = None,
    as_of: datetime | None = None,
    n_per_collection: int = 50,
    with_asset_key: bool = False,
    partials: DataFrame | None = None,
    asset_partials: DataFrame | None = None,
    **options,
) -> DataFrame:
    """All collection- and asset-level metrics of one grain.

    Each plan reads only its own rows and columns, so raw input should be
    landed first. Collections and assets could share a scan through grouping
    sets, but their groups differ so much in number that this measures slower
    (README). Partial groups, if given, serve the collections, and those with
    assets (``plans.rollup.asset_chain``) the assets.
    """
    options["with_asset_key"] = with_asset_key
    source, how = _merged(clean, partials)
    if grain == ALL_TIME:
        collections = [[C.COLLECTION_ALL_TIME]]
        top_sales = replace(C.TOP_ASSETS_BY_SALES_ALL_TIME, top_n=n_per_collection)
        top_transfers = replace(C.TOP_ASSETS_BY_TRANSFERS_ALL_TIME, top_n=n_per_collection)
        assets = [[top_sales, top_transfers]]
    else:
        collections = [[C.COLLECTION_SALES], [C.COLLECTION_TRANSACTIONS]]
        assets = [[C.TOP_ASSETS_BY_SALES], [C.ASSET_TRANSFERS]]
    options.update(slide=slide, as_of=as_of)
    feeds = [_collections(source, families, grain, **options, **how) for families in collections]
    source, how = _merged(clean, asset_partials)
    feeds += [_collections(source, families, grain, **options, **how) for families in assets]
    return reduce(DataFrame.unionByName, feeds)


def _with_empty_totals(feed: DataFrame, as_of: datetime | None) -> DataFrame:
    """Over no events the totals still exist: counts 0, sums NULL.

    Grouping sets give no row there, so zero counts are merged into the feed's
    few rows (six totals and two short rankings).
    """
    counts = {"total_number_of_events", "total_transfers", "total_sales"}
    totals = [
        F.struct(
            F.lit(metric_name(name, ALL_TIME)).alias("metric"),
            F.lit(0.0 if name in counts else None).cast("double").alias("value"),
        )
        for name, _ in C.GLOBAL_ALL_TIME.metrics
    ]
    empty = (
        feed.sparkSession.range(1)
        .select(F.inline(F.array(*totals)))
        .select("*", run_time(as_of).alias("timestamp"), F.lit("").alias("collection"))
    )
    return (
        feed.unionByName(empty)
        .groupBy("metric", "timestamp", "collection")
        .agg(F.max("value").alias("value"))
        .select(*GLOBAL_COLUMNS)
    )

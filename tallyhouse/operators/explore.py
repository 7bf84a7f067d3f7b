"""Profiles and drill-downs over clean events and metric rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.events import is_transfer
from tallyhouse.functions.ranking import keep_top
from tallyhouse.functions.windows import event_window, metric_name, time_literal
from tallyhouse.operators.events import sales_items, transferred_items
from tallyhouse.operators.quantiles import quantiles
from tallyhouse.schemas import SOLD

WINDOW_COLUMNS = ["window_start", "window_end"]


def _with_window(rows: DataFrame, grain: str, slide: str | None = None) -> DataFrame:
    """Rows with their window's bounds; one copy per window if windows slide."""
    return (
        rows.withColumn("window", event_window(grain, slide))
        .withColumn("window_start", F.col("window.start"))
        .withColumn("window_end", F.col("window.end"))
        .drop("window")
    )


def event_type_counts(clean: DataFrame, priced_only: bool = False) -> DataFrame:
    if priced_only:
        clean = clean.filter(F.col("usd_price").isNotNull())
    return clean.groupBy("event_type").agg(F.count(F.lit(1)).alias("count"))


def time_extent(clean: DataFrame) -> DataFrame:
    return clean.agg(F.min("sent_at").alias("first_event_at"), F.max("sent_at").alias("last_event_at"))


def range_profile(clean: DataFrame, after: datetime, until: datetime) -> DataFrame:
    """Per event type, what was sent within ``(after, until]``."""
    return (
        clean.filter((F.col("sent_at") > time_literal(after)) & (F.col("sent_at") <= time_literal(until)))
        .filter(F.col("quantity").isNotNull())
        .groupBy("event_type")
        .agg(
            F.min("sent_at").alias("first_event_at"),
            F.max("sent_at").alias("last_event_at"),
            F.count(F.lit(1)).alias("count"),
            F.sum("quantity").alias("total_number_of_assets"),
        )
    )


def window_profile(clean: DataFrame, grain: str, slide: str | None = None) -> DataFrame:
    """Counts per window with its first and last event, newest window first."""
    transfer = is_transfer()
    return (
        _with_window(clean, grain, slide)
        .groupBy(*WINDOW_COLUMNS)
        .agg(
            F.min("sent_at").alias("first_event_at"),
            F.max("sent_at").alias("last_event_at"),
            F.count(F.lit(1)).alias("number_of_events"),
            F.count_if(transfer).alias("number_of_transfers"),
            F.count_if(~transfer).alias("number_of_not_transfers"),
            F.sum(F.when(transfer, F.col("quantity"))).alias("total_assets_transferred"),
            F.sum("quantity").alias("number_of_assets"),
        )
        .orderBy(F.desc("window_start"))
    )


def window_transactions(clean: DataFrame, grain: str, slide: str | None = None) -> DataFrame:
    return (
        _with_window(transferred_items(clean), grain, slide)
        .groupBy(*WINDOW_COLUMNS)
        .agg(
            F.count(F.lit(1)).alias("transfers_count"),
            F.sum("quantity").alias("items_transferred_count"),
        )
        .orderBy("window_start")
    )


def window_sales(clean: DataFrame, grain: str, slide: str | None = None) -> DataFrame:
    return (
        _with_window(sales_items(clean, SOLD), grain, slide)
        .groupBy(*WINDOW_COLUMNS)
        .agg(F.sum("usd_price").alias("usd_volume"), F.count(F.lit(1)).alias("sales_count"))
        .orderBy("window_start")
    )


def collection_windows(clean: DataFrame, grain: str, top_n: int | None = None) -> DataFrame:
    """Sold volume per (collection, window), all of them or the top n per window."""
    windows = (
        _with_window(sales_items(clean, SOLD), grain)
        .filter(F.col("collection_slug").isNotNull())
        .groupBy("collection_slug", *WINDOW_COLUMNS)
        .agg(
            F.sum("usd_price").alias("usd_volume"),
            F.count(F.lit(1)).alias("sales_count"),
            F.min("usd_price").alias("floor_price"),
            F.avg("usd_price").alias("avg_assets_price"),
        )
    )
    if top_n is None:
        return windows
    order = [F.desc_nulls_last("usd_volume"), F.asc_nulls_last("collection_slug")]
    return keep_top(windows, WINDOW_COLUMNS, order, top_n, spread=F.col("collection_slug"))


def sales_of_top_collections(clean: DataFrame, grain: str, top_n: int | None = None) -> DataFrame:
    """Sales of any collection that made the top in some window.

    The list of collections stays a table: a semi join, which AQE turns into a
    broadcast only if the list turns out small, and whose large side it splits
    where one collection dominates. The list keeps its duplicates, one per
    window: a distinct between shuffle and join would stop AQE from splitting.
    """
    listed = collection_windows(clean, grain, top_n).select("collection_slug")
    return sales_items(clean, SOLD).join(listed, "collection_slug", "left_semi")


def sales_in_top_windows(clean: DataFrame, grain: str, top_n: int | None = None) -> DataFrame:
    """Listed collections' sales with the top window each falls in, or NULL
    bounds where it falls in none.

    "Sent within [start, end)" is tested by computing a sale's own window and
    matching it exactly. The join then has equality keys only, time among them,
    so a collection's sales are spread over its windows and never meet them all.
    """
    windows = collection_windows(clean, grain, top_n).select(
        F.col("collection_slug").alias("slug"), *WINDOW_COLUMNS
    )
    # Window functions drop rows without a time; a stand-in time keeps them.
    some_time = F.coalesce("sent_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    sales = sales_of_top_collections(clean, grain, top_n).withColumn(
        "own_end", F.window(some_time, grain)["end"]
    )
    same_window = (
        (F.col("collection_slug") == F.col("slug"))
        & (F.col("own_end") == F.col("window_end"))
        & F.col("sent_at").isNotNull()
    )
    return sales.join(windows, same_window, "left").select(
        "sent_at", "collection_slug", "item_name", "item_url", "image_url", "usd_price", *WINDOW_COLUMNS
    )


def top_sales_by_price(
    clean: DataFrame, grain: str, n: int = 20, top_n: int | None = None
) -> DataFrame:
    """The n dearest single sales of each (top) collection in each window.

    Sales are ranked before the windows are joined, so only n rows per
    collection and window reach the join.
    """
    sales = _with_window(sales_items(clean, SOLD), grain).filter(F.col("collection_slug").isNotNull())
    group = ["collection_slug", *WINDOW_COLUMNS]
    ties = ["sent_at", "item_nft_id", "item_name", "item_url", "image_url"]
    order = [F.desc_nulls_last("usd_price"), *[F.asc_nulls_last(c) for c in ties]]
    top = keep_top(sales.select(*group, "usd_price", *ties), group, order, n, spread=F.struct(*ties))
    if top_n is not None:
        top = top.join(collection_windows(clean, grain, top_n).select(*group), group, "left_semi")
    return top.select(
        F.lit(metric_name("collection_top_assets_by_price", grain)).alias("metric"),
        F.col("window_end").alias("timestamp"),
        F.col("collection_slug").alias("collection"),
        F.col("usd_price").alias("value"),
        F.col("item_name").alias("asset_name"),
        F.col("item_url").alias("asset_url"),
        "image_url",
    )


def top_collection_stats(clean: DataFrame, grain: str, top_n: int | None = None) -> DataFrame:
    """Price statistics of (top) collections per window, as long rows."""
    measures = {
        "floor_price": "floor_price",
        "total_volume": "usd_volume",
        "avg_assets_price": "avg_assets_price",
        "total_sales": "sales_count",
    }
    wide = collection_windows(clean, grain, top_n).select(
        "collection_slug",
        "window_end",
        *[F.col(source).cast("double").alias(name) for name, source in measures.items()],
    )
    no_text = F.lit(None).cast("string")
    return wide.unpivot(["collection_slug", "window_end"], list(measures), "metric", "value").select(
        F.concat(F.lit("collection_"), "metric", F.lit(metric_name("", grain))).alias("metric"),
        F.col("window_end").alias("timestamp"),
        F.col("collection_slug").alias("collection"),
        "value",
        no_text.alias("asset_name"),
        no_text.alias("asset_url"),
        no_text.alias("image_url"),
    )


def metric_value_counts(rows: DataFrame, below: float | None = None) -> DataFrame:
    """How often each value occurs, optionally only values under a bound."""
    if below is not None:
        rows = rows.filter(F.col("value") < below)
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def metric_name_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("count"))


def metric_quartiles(rows: DataFrame) -> DataFrame:
    """Exact quartiles of the values, between two values in proportion; no task holds them all."""
    found = quantiles(rows, "value", [0.25, 0.5, 0.75])
    return rows.sparkSession.createDataFrame([tuple(found)], "q1 double, q2 double, q3 double")


def metric_summary(rows: DataFrame) -> DataFrame:
    """Count, missing, mean, spread and extremes of the values. The quartiles
    are approximate (relative rank error 1e-4), so no task holds all values."""
    value = F.col("value")
    quartiles = F.percentile_approx(value, [0.25, 0.5, 0.75], 10000)
    return rows.agg(
        F.count(value).alias("count"),
        F.count_if(value.isNull()).alias("null_count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        quartiles.alias("quartiles"),
        F.max(value).alias("max"),
    )

"""Typed reads of metric rows, over the stored table or any frame like it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhouse.functions.windows import metric_name, time_literal

# Older dashboards ask for windowed asset volumes under the all-time name.
ALIASES = {"collection_top_assets_by_usd_volume": "collection_top_assets_by_sales_volume"}


def stored_name(metric: str, grain: str) -> str:
    """The name rows carry: the grain's suffix, and one spelling per metric."""
    if metric in ALIASES and "_".join(grain.split()) != "all_time":
        metric = ALIASES[metric]
    return metric_name(metric, grain)


def read_global(
    rows: DataFrame,
    metric: str | None = None,
    grain: str | None = None,
    from_ts: datetime | None = None,
    to_ts: datetime | None = None,
    limit: int | None = None,
    order_ascending: bool | None = None,
) -> DataFrame:
    """Global metric rows. Metric and grain go together; both time bounds are
    included; ``limit`` 0 or None means all. Rows come by collection, newest
    first, unless an order by time is asked for."""
    if bool(metric) != bool(grain):
        raise ValueError("metric and grain must be given together")
    if metric and grain:
        rows = rows.filter(F.col("metric") == stored_name(metric, grain))
    key_order = [F.asc("metric"), F.asc_nulls_last("collection"), F.desc("timestamp")]
    return _cut(rows, from_ts, to_ts, limit, order_ascending, key_order)


def read_collection(
    rows: DataFrame,
    collection: str | None = None,
    metric: str | None = None,
    grain: str | None = None,
    from_ts: datetime | None = None,
    to_ts: datetime | None = None,
    limit: int | None = None,
    order_ascending: bool | None = None,
) -> DataFrame:
    """Collection metric rows. Collection, metric and grain go together."""
    if bool(metric) != bool(grain):
        raise ValueError("metric and grain must be given together")
    if bool(metric) != bool(collection):
        raise ValueError("collection must be given with metric and grain")
    if collection and metric and grain:
        rows = rows.filter(
            (F.col("collection") == collection) & (F.col("metric") == stored_name(metric, grain))
        )
    key_order = [F.asc_nulls_last("collection"), F.asc("metric"), F.desc("timestamp")]
    return _cut(rows, from_ts, to_ts, limit, order_ascending, key_order)


def _cut(
    rows: DataFrame,
    from_ts: datetime | None,
    to_ts: datetime | None,
    limit: int | None,
    order_ascending: bool | None,
    key_order: list[Column],
) -> DataFrame:
    if from_ts:
        rows = rows.filter(F.col("timestamp") >= time_literal(from_ts))
    if to_ts:
        rows = rows.filter(F.col("timestamp") <= time_literal(to_ts))
    if order_ascending is None:
        order = key_order
    else:
        by_time = F.asc("timestamp") if order_ascending else F.desc("timestamp")
        order = [by_time, F.asc("metric"), F.asc_nulls_last("collection")]
    # Rows of one window differ by asset: break ties so a limit is repeatable.
    ties = [c for c in ("asset_key", "asset_name", "asset_url", "image_url") if c in rows.columns]
    rows = rows.orderBy(*order, *[F.asc_nulls_last(c) for c in ties])
    return rows.limit(limit) if limit else rows


def latest_value(rows: DataFrame) -> DataFrame:
    """The newest row of one metric, as an indicator shows it."""
    order = [F.desc("timestamp"), F.asc_nulls_last("collection")]
    order += [F.asc(c) for c in ("asset_key",) if c in rows.columns]
    return rows.orderBy(*order).limit(1).select("metric", "timestamp", "value")


def page_indicators(
    rows: DataFrame, metrics: Sequence[str], grain: str, collection: str | None = None
) -> DataFrame:
    """The newest value of each listed metric, in one read."""
    names = [stored_name(metric, grain) for metric in metrics]
    rows = rows.filter(F.col("metric").isin(*names))
    if collection is not None:
        rows = rows.filter(F.col("collection") == collection)
    newest = F.max_by(F.struct("timestamp", "value"), F.struct("timestamp", "collection"))
    return rows.groupBy("metric").agg(newest.alias("newest")).select(
        "metric", "newest.timestamp", "newest.value"
    )


def latest_per_group(rows: DataFrame, group: str) -> DataFrame:
    """Rows at each group's newest timestamp. Ties there are all kept.

    A rank of 1 is cut in every task before the shuffle, so a group with most
    of the rows does not travel whole.
    """
    newest_first = W.partitionBy(group).orderBy(F.desc_nulls_last("timestamp"))
    return (
        rows.filter(F.col(group).isNotNull())
        .withColumn("_rank", F.rank().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def latest_top(rows: DataFrame, group: str, n: int = 10) -> DataFrame:
    """The n highest of each group's newest values."""
    ties = [F.asc_nulls_last(c) for c in (group, "asset_key", "asset_url", "image_url") if c in rows.columns]
    return latest_per_group(rows, group).orderBy(F.desc_nulls_last("value"), *ties).limit(n)


def series(rows: DataFrame, hue: str, points: int | None = None) -> DataFrame:
    """Lines to plot: all points, or the newest ``points`` of every hue value."""
    if points is None:
        return rows.select("timestamp", "value", F.col(hue).alias("hue"))
    ties = [F.asc_nulls_last(c) for c in ("asset_key", "asset_url", "image_url") if c in rows.columns]
    newest_first = W.partitionBy(hue).orderBy(
        F.desc("timestamp"), F.desc_nulls_last("value"), *ties
    )
    return (
        rows.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") <= points)
        .select("timestamp", "value", F.col(hue).alias("hue"))
    )


def display_table(
    rows: DataFrame,
    group: str,
    group_alias: str | None = None,
    value_alias: str = "Value",
    href_page: str | None = None,
    href_col: str | None = None,
) -> DataFrame:
    """Rows as shown: a link per group and the value with thousands commas."""
    label = F.col(group)
    if href_page:
        label = F.concat(F.lit(f"<a target='_Self' href='{href_page}"), label, F.lit("'>"), label, F.lit("</a>"))
    elif href_col:
        label = F.concat(F.lit("<a href='"), F.col(href_col), F.lit("'>"), label, F.lit("</a>"))
    return rows.select(
        label.alias(group_alias or group), F.format_number("value", 0).alias(value_alias)
    )

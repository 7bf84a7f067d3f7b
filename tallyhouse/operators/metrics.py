"""Metric rows from clean events: one scan and one linear plan per call.

Families passed together share the scan, the partial aggregation and the
shuffle: levels are grouping sets of one aggregate, and all rankings run in one
window over rows already cut to n per group on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.events import asset_key, asset_name, is_sale, is_transfer
from tallyhouse.functions.ranking import keep_top
from tallyhouse.functions.windows import ALL_TIME, event_window, metric_name, run_time, window_end
from tallyhouse.operators.catalogue import Family, measured, measures, merged_measures
from tallyhouse.schemas import ASSET_COLUMNS, SALE_TYPES

LEVEL_KEYS = {
    "global": [],
    "collection": ["collection_slug"],
    "asset": ["collection_slug", *ASSET_COLUMNS],
}
LEVELS = list(LEVEL_KEYS)
METRIC_TYPE = "array<struct<metric: string, value: double>>"


def metric_rows(
    clean: DataFrame,
    families: Sequence[Family],
    grain: str = ALL_TIME,
    slide: str | None = None,
    as_of: datetime | None = None,
    sale_types: Sequence[str] = SALE_TYPES,
    from_partials: bool = False,
) -> DataFrame:
    """Long rows ``metric, timestamp, collection, value, asset_name, asset_url,
    image_url, asset_key`` for the given families at one grain.

    All-time rows carry ``as_of`` (now, if not given) as their timestamp.
    ``clean`` may be the partial groups of ``plans.rollup`` in place of events.
    """
    if from_partials and any(f.level == "asset" for f in families) and ASSET_COLUMNS[0] not in clean.columns:
        raise ValueError("these partial groups have no assets")
    rows = clean.filter(_wanted_rows(families, sale_types))
    families, aggregates = measured(families, sale_types, merged_measures if from_partials else measures)
    time_key = []
    if grain != ALL_TIME:
        rows = rows.withColumn("timestamp", window_end(grain, slide))
        time_key = ["timestamp"]
    groups = _group(rows, families, time_key, _named(aggregates))
    if not time_key:
        groups = groups.withColumn("timestamp", run_time(as_of))
    picked = _keep_ranked(_pick(groups, families), families)
    return _emit(picked, families, grain)


def metric_stream(
    clean: DataFrame,
    families: Sequence[Family],
    grain: str,
    slide: str | None = None,
    watermark: str | None = None,
    sale_types: Sequence[str] = SALE_TYPES,
) -> DataFrame:
    """The same rows from a stream: one stateful aggregate over all levels.

    Each event is copied once per level it counts towards, so the source is
    read once. The watermark sits on the clean events, before any filter, and
    the window struct stays a grouping key so that state is dropped behind it.
    """
    if any(f.rank_by for f in families):
        raise ValueError("rankings need a whole group: rank the stored rows on read")
    if watermark:
        clean = clean.withWatermark("sent_at", watermark)
    rows = clean.filter(_wanted_rows(families, sale_types))
    families, aggregates = measured(families, sale_types, measures)
    levels = [
        F.when(_wanted_rows(at_level, sale_types), F.lit(level))
        for level in LEVELS
        if (at_level := [f for f in families if f.level == level])
    ]
    rows = rows.withColumn("level", F.explode(F.array(*levels))).filter(F.col("level").isNotNull())
    keys = [
        F.when(F.col("level").isin(*_levels_with(name)), F.col(name)).alias(name)
        for name in LEVEL_KEYS["asset"]
    ]
    groups = (
        rows.groupBy(event_window(grain, slide), "level", *keys)
        .agg(*_named(aggregates))
        .withColumn("timestamp", F.col("window.end"))
    )
    return _emit(_pick(groups, families), families, grain)


def _levels_with(key: str) -> list[str]:
    return [level for level, keys in LEVEL_KEYS.items() if key in keys]


def _named(aggregates: dict[str, Column]) -> list[Column]:
    return [aggregate.alias(name) for name, aggregate in aggregates.items()]


def _wanted_rows(families: Sequence[Family], sale_types: Sequence[str]) -> Column:
    """The events any of the families counts; pushed down to the scan."""
    kinds = {f.rows for f in families}
    if "events" in kinds:
        return F.lit(True)
    tests = []
    sales = {t for f in families if f.rows in ("sales", "trades") for t in f.sale_types or sale_types}
    if sales:
        tests.append(is_sale(sorted(sales)))
    if kinds & {"transfers", "trades"}:
        tests.append(is_transfer())
    return reduce(lambda a, b: a | b, tests)


def _group(
    rows: DataFrame,
    families: Sequence[Family],
    time_key: list[str],
    aggregates: list[Column],
) -> DataFrame:
    levels = [level for level in LEVELS if any(f.level == level for f in families)]
    sets = [time_key + LEVEL_KEYS[level] for level in levels]
    if len(levels) == 1:
        groups = rows.groupBy(*sets[0]).agg(*aggregates).withColumn("level", F.lit(levels[0]))
    else:
        columns = [[F.col(c) for c in keys] for keys in sets]
        level = _coarsest_first(levels).alias("level")
        groups = rows.groupingSets(columns, *columns[-1]).agg(*aggregates, level)
    for key in LEVEL_KEYS["asset"]:
        if key not in groups.columns:
            groups = groups.withColumn(key, F.lit(None).cast("string"))
    return groups


def _coarsest_first(levels: list[str]) -> Column:
    """The level of a grouping-set row: the coarsest whose next key is rolled up."""
    level = F.lit(levels[-1])
    for coarser, finer in reversed(list(zip(levels, levels[1:]))):
        rolled_up = next(k for k in LEVEL_KEYS[finer] if k not in LEVEL_KEYS[coarser])
        level = F.when(F.grouping(rolled_up) == 1, F.lit(coarser)).otherwise(level)
    return level


def _pick(groups: DataFrame, families: Sequence[Family]) -> DataFrame:
    """One row per (group, family it belongs to), as column ``family``."""
    members = [F.when(_present(f), F.lit(i)) for i, f in enumerate(families)]
    if len({f.level for f in families}) == len(families):
        # No group can belong to two families.
        picked = groups.withColumn("family", F.coalesce(*members))
    else:
        picked = groups.withColumn("family", F.explode(F.array(*members)))
    return picked.filter(F.col("family").isNotNull())


def _present(family: Family) -> Column:
    at_level = F.col("level") == family.level
    # The one global group of all events exists over no rows too.
    return at_level if (family.level, family.rows) == ("global", "events") else at_level & family.present()


def _case(families: Sequence[Family], value) -> Column:
    """An expression chosen by the row's family."""
    if len(families) == 1:
        return value(families[0])
    result = F.when(F.col("family") == 0, value(families[0]))
    for i, family in enumerate(families[1:], start=1):
        result = result.when(F.col("family") == i, value(family))
    return result


def _keep_ranked(picked: DataFrame, families: Sequence[Family]) -> DataFrame:
    ranked = [f for f in families if f.rank_by]
    if not ranked:
        return picked
    if any(f.level == "asset" and not f.rank_by for f in families):
        raise ValueError("an unranked asset family would be shuffled twice: call it alone")
    # Assets compete within their collection, collections with each other. An
    # unranked collection row is alone in its scope, so it always ranks first.
    no_scope = F.lit(None).cast("string")
    scope = _case(
        families,
        lambda f: no_scope
        if f.level == "global" or (f.level == "collection" and f.rank_by)
        else F.col("collection_slug"),
    )
    by = _case(families, lambda f: f.expression(f.rank_by or "events").cast("double"))
    ties = [F.asc_nulls_last(key) for key in LEVEL_KEYS["asset"]]
    sizes = {f.top_n for f in ranked}
    # Rows are sorted by these keys; the first should tell most of them apart.
    return keep_top(
        picked.withColumn("scope", scope).withColumn("rank_value", by),
        ["timestamp", "scope", "family"],
        [F.desc_nulls_last("rank_value"), *ties],
        max(sizes),
        spread=F.struct(*LEVEL_KEYS["asset"]),
        own_n=_case(families, lambda f: F.lit(f.top_n or 1)) if len(sizes) > 1 else None,
    )


def _emit(picked: DataFrame, families: Sequence[Family], grain: str) -> DataFrame:
    """Wide groups to long rows, keeping NULL values."""

    def long(family: Family) -> Column:
        pairs = [
            F.struct(
                F.lit(metric_name(name, grain)).alias("metric"),
                family.expression(value).cast("double").alias("value"),
            )
            for name, value in family.metrics
        ]
        return F.array(*pairs).cast(METRIC_TYPE)

    at_asset = F.col("level") == "asset"
    return picked.select(
        F.inline(_case(families, long)),
        "timestamp",
        F.when(F.col("level") == "global", F.lit("")).otherwise(F.col("collection_slug")).alias("collection"),
        F.when(at_asset, asset_name()).alias("asset_name"),
        F.when(at_asset, F.col("item_url")).alias("asset_url"),
        F.when(at_asset, F.col("image_url")).alias("image_url"),
        F.when(at_asset, asset_key()).otherwise(F.lit("")).alias("asset_key"),
    )

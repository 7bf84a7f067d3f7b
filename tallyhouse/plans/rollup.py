"""Many grains from one pass over the events.

Counts, sums and minima of a window can be merged from those of the smaller
windows it consists of, and all windows are aligned to the epoch. So the events
are grouped once, into partial measures per base window, event type and
collection; each grain's global and collection metrics come from those, whatever
counts as a sale.

Assets repeat less: one asset is seldom traded twice in an hour. Their partial
groups are a chain of windows, each made from the one before it, with only those
links that at least halve the rows; which these are is measured on the events.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.windows import ALL_TIME, UNIT_SECONDS, seconds
from tallyhouse.operators.catalogue import merged_partials, partial_measures
from tallyhouse.schemas import ASSET_COLUMNS
from tallyhouse.session import materialise

KEYS = ["event_type", "collection_slug"]
#: A link of the chain has at most this share of the rows it is made from.
WORTH = 0.5


def _start(base: str | None) -> Column:
    """The start of the base window; NULL for events without a time, and for one window of all time."""
    if base is None:
        # Whether there is a time stays visible: windows leave those without out.
        return F.lit(None).cast("timestamp_ntz")
    # A stand-in time keeps the rows that a window function would drop.
    some_time = F.coalesce("sent_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.when(F.col("sent_at").isNotNull(), F.window(some_time, base)["start"])


def partial_groups(clean: DataFrame, base: str | None = "1 hour", assets: bool = False) -> DataFrame:
    """Partial measures per base window, event type and collection (and asset).

    ``sent_at`` is the start of the base window, NULL for events without a
    time, which count in all-time metrics.
    """
    keys = [*KEYS, *(ASSET_COLUMNS if assets else [])]
    aggregates = [a.alias(name) for name, a in partial_measures().items()]
    keyed = clean.select(*keys, "usd_price", "eth_price", "quantity", _start(base).alias("sent_at"))
    return keyed.groupBy("sent_at", *keys).agg(*aggregates)


def merged_groups(partials: DataFrame, base: str | None) -> DataFrame:
    """Partial groups of longer windows (``None``: all time) from those of shorter ones."""
    keys = [c for c in [*KEYS, *ASSET_COLUMNS] if c in partials.columns]
    aggregates = [a.alias(name) for name, a in merged_partials().items()]
    return partials.withColumn("sent_at", _start(base)).groupBy("sent_at", *keys).agg(*aggregates)


def asset_chain(
    clean: DataFrame, grains: Sequence[str], path: str, slide: str | None = None, worth: float = WORTH
) -> dict[str, DataFrame]:
    """Per grain the partial groups of assets to read, for grains that have any worth reading.

    The events are read twice: to measure how many groups each window length
    would have (one aggregate, counts within 5%), and to make the first link.
    """
    bases = {grain: None if grain == ALL_TIME else common_base([grain], slide) for grain in grains}
    lengths = sorted({seconds(b) if b else float("inf") for b in bases.values()})
    sizes = clean.select(
        F.count(F.lit(1)).alias("rows"),
        *(F.approx_count_distinct(F.struct(_number(n), *KEYS, *ASSET_COLUMNS), 0.05).alias(f"n{i}") for i, n in enumerate(lengths)),
    ).first()
    last, size, links = None, sizes["rows"], {}
    for i, length in enumerate(lengths):
        if sizes[f"n{i}"] > worth * size or (links and length != float("inf") and length % max(links)):
            continue
        made = partial_groups(clean, _text(length), assets=True) if last is None else merged_groups(last, _text(length))
        last, size = materialise(made, f"{path}/{i}"), sizes[f"n{i}"]
        links[length] = last
    found = {}
    for grain, base in bases.items():
        own = seconds(base) if base else float("inf")
        fit = [n for n in links if n == own or (own == float("inf") and n < own) or (n < own and own % n == 0)]
        if fit:
            found[grain] = links[max(fit)]
    return found


def _number(length: float) -> Column:
    """Tells windows of a length apart."""
    if length == float("inf"):
        return F.lit(0)
    return F.floor(F.unix_seconds(F.col("sent_at").cast("timestamp")) / int(length))


def _text(length: float) -> str | None:
    return None if length == float("inf") else f"{int(length)} seconds"


def common_base(grains: Sequence[str], slide: str | None = None) -> str:
    """The longest window that all the given windows consist of."""
    lengths = [seconds(grain) for grain in [*grains, slide] if grain and grain != ALL_TIME]
    return f"{gcd(*lengths) or UNIT_SECONDS['day']} seconds"

"""The metric catalogue: what each family counts, where, and what it emits.

A family is data. To add a metric, write another ``Family`` whose values are
SQL expressions over the measures below, and pass it to ``metric_rows``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.events import is_sale, is_transfer
from tallyhouse.schemas import SALE_TYPES, SOLD


@dataclass(frozen=True)
class Family:
    """One group of metrics that share a level, a row rule and a ranking.

    level    "global", "collection" or "asset"
    rows     the events that make a group exist: "events", "sales",
             "transfers" or "trades" (sales or transfers)
    metrics  metric name without grain -> expression over the measures
    rank_by  measure to rank groups by, highest first, or None to keep all
    top_n    how many groups to keep per ranking
    sale_types  event types that are sales to this family, where they are not
             those of the call
    suffix   of the measures that such a family reads; set by ``measured``
    """

    name: str
    level: str
    rows: str
    metrics: tuple[tuple[str, str], ...]
    rank_by: str | None = None
    top_n: int | None = None
    sale_types: tuple[str, ...] | None = None
    suffix: str = ""

    def expression(self, text: str) -> Column:
        """An SQL text over the measures, as this family means them."""
        return F.expr(_OF_SALES.sub(rf"\1{self.suffix}", text) if self.suffix else text)

    def present(self) -> Column:
        return self.expression(PRESENT[self.rows])


# A group exists in a family when this holds for its measures.
PRESENT = {
    "events": "events > 0",
    "sales": "sales > 0",
    "transfers": "transfers > 0",
    "trades": "sales > 0 or transfers > 0",
}


_OF_SALES = re.compile(r"\b(sales|sold|usd|eth|floor_usd|avg_usd)\b")


def measures(sale_types: Sequence[str] = SALE_TYPES) -> dict[str, Column]:
    """Aggregates every family draws on. All combine before the shuffle."""
    sale, transfer = is_sale(sale_types), is_transfer()
    usd, eth = F.when(sale, F.col("usd_price")), F.when(sale, F.col("eth_price"))
    return {
        "events": F.count(F.lit(1)),
        "transfers": F.count_if(transfer),
        "items": F.sum(F.when(transfer, F.col("quantity"))),
        "sales": F.count_if(sale),
        "sold": F.sum(F.when(sale, F.col("quantity"))),
        "usd": F.sum(usd),
        "eth": F.sum(eth),
        "floor_usd": F.min(usd),
        "avg_usd": F.avg(usd),
    }


def partial_measures() -> dict[str, Column]:
    """What to keep per small group of one event type, so that any larger group,
    whatever counts as a sale there, can be merged from it."""
    return {
        "count": F.count(F.lit(1)),
        "pieces": F.sum("quantity"),
        "usd_sum": F.sum("usd_price"),
        "eth_sum": F.sum("eth_price"),
        "usd_low": F.min("usd_price"),
        "priced": F.count("usd_price"),
    }


def merged_partials() -> dict[str, Column]:
    """Partial measures of a group from those of its parts."""
    return {name: (F.min if name == "usd_low" else F.sum)(name) for name in partial_measures()}


def merged_measures(sale_types: Sequence[str] = SALE_TYPES) -> dict[str, Column]:
    """The measures of a group from the partial measures of its parts."""
    sale, transfer = is_sale(sale_types), is_transfer()
    of = lambda test, name: F.when(test, F.col(name))
    return {
        "events": F.sum("count"),
        "transfers": F.sum(of(transfer, "count").otherwise(0)),
        "items": F.sum(of(transfer, "pieces")),
        "sales": F.sum(of(sale, "count").otherwise(0)),
        "sold": F.sum(of(sale, "pieces")),
        "usd": F.sum(of(sale, "usd_sum")),
        "eth": F.sum(of(sale, "eth_sum")),
        "floor_usd": F.min(of(sale, "usd_low")),
        "avg_usd": F.try_divide(F.sum(of(sale, "usd_sum")), F.sum(of(sale, "priced"))),
    }


def measured(
    families: Sequence[Family], sale_types: Sequence[str], make: Callable[[Sequence[str]], dict[str, Column]]
) -> tuple[list[Family], dict[str, Column]]:
    """The families and all measures they read, sales of one meaning counted once."""
    kinds = list(dict.fromkeys([tuple(sale_types), *(f.sale_types for f in families if f.sale_types)]))
    suffix = {kind: f"_{i}" if i else "" for i, kind in enumerate(kinds)}
    used = {f.sale_types or kinds[0] for f in families}
    aggregates = {}
    for kind in kinds:
        for name, aggregate in make(kind).items():
            if kind in used or kind == kinds[0]:
                of_sales = _OF_SALES.fullmatch(name)
                aggregates.setdefault(name + suffix[kind] if of_sales else name, aggregate)
    return [replace(f, suffix=suffix[f.sale_types or kinds[0]]) for f in families], aggregates


GLOBAL_WINDOWED = Family(
    "global_windowed",
    "global",
    "events",
    (
        ("total_number_of_events", "events"),
        ("total_transfers", "transfers"),
        ("total_items_transferred", "coalesce(items, 0)"),
        ("total_sales", "sales"),
        ("total_eth_volume", "coalesce(eth, 0)"),
        ("total_usd_volume", "coalesce(usd, 0)"),
    ),
)
# Sums over no rows stay NULL; unpriced rows add nothing but count as rows.
GLOBAL_ALL_TIME = Family(
    "global_all_time",
    "global",
    "events",
    (
        ("total_number_of_events", "events"),
        ("total_transfers", "transfers"),
        ("total_items_transferred", "items"),
        ("total_sales", "sales"),
        ("total_eth_volume", "if(sales > 0, coalesce(eth, 0), null)"),
        ("total_usd_volume", "if(sales > 0, coalesce(usd, 0), null)"),
    ),
)
TOP_COLLECTIONS_BY_SALES = Family(
    "top_collections_by_sales",
    "collection",
    "sales",
    (
        ("top_collections_by_sales_volume_usd_volume", "usd"),
        ("top_collections_by_sales_volume_sales_count", "sales"),
        ("top_collections_by_sales_volume_floor_usd_price", "floor_usd"),
        ("top_collections_by_sales_volume_avg_usd_price", "avg_usd"),
    ),
    rank_by="usd",
    top_n=10,
)
TOP_COLLECTIONS_BY_TRANSFERS = Family(
    "top_collections_by_transfers",
    "collection",
    "transfers",
    (
        ("top_collections_by_transfers_volume_transfers_count", "transfers"),
        ("top_collections_by_transfers_volume_items_transferred", "items"),
    ),
    rank_by="transfers",
    top_n=10,
)
TOP_COLLECTIONS_BY_SALES_ALL_TIME = Family(
    "top_collections_by_sales_all_time",
    "collection",
    "sales",
    (("top_collections_by_sales_volume_usd_price", "usd"),),
    rank_by="usd",
    top_n=10,
)
TOP_COLLECTIONS_BY_TRANSFERS_ALL_TIME = Family(
    "top_collections_by_transfers_all_time",
    "collection",
    "transfers",
    (("top_collections_by_transfers_volume_transfers_count", "transfers"),),
    rank_by="transfers",
    top_n=10,
)
COLLECTION_SALES = Family(
    "collection_sales",
    "collection",
    "sales",
    (
        ("collection_total_usd_volume", "usd"),
        ("collection_total_sales_count", "sales"),
        ("collection_total_assets_sold", "sold"),
        ("collection_floor_assets_usd_price", "floor_usd"),
        ("collection_avg_assets_usd_price", "avg_usd"),
    ),
)
COLLECTION_TRANSACTIONS = Family(
    "collection_transactions",
    "collection",
    "transfers",
    (
        ("collection_total_transfers", "transfers"),
        ("collection_total_items_transferred", "items"),
    ),
)
# A collection seen on one side only keeps NULL, not 0, on the other.
COLLECTION_ALL_TIME = Family(
    "collection_all_time",
    "collection",
    "trades",
    (
        ("collection_total_transfers", "nullif(transfers, 0)"),
        ("collection_total_items_transferred", "items"),
        ("collection_total_sales_count", "nullif(sales, 0)"),
        ("collection_total_assets_sold", "sold"),
        ("collection_total_usd_volume", "if(sales > 0, coalesce(usd, 0), null)"),
        ("collection_total_eth_volume", "if(sales > 0, coalesce(eth, 0), null)"),
        ("collection_floor_assets_usd_price", "floor_usd"),
        ("collection_avg_assets_usd_price", "avg_usd"),
    ),
)
ASSET_TRANSFERS = Family(
    "asset_transfers",
    "asset",
    "transfers",
    (("collection_top_assets_by_transfers", "transfers"),),
)
TOP_ASSETS_BY_TRANSFERS = Family(
    "top_assets_by_transfers",
    "asset",
    "transfers",
    (("collection_top_assets_by_transfers", "transfers"),),
    rank_by="transfers",
    top_n=20,
)
TOP_ASSETS_BY_SALES = Family(
    "top_assets_by_sales",
    "asset",
    "sales",
    (("collection_top_assets_by_sales_volume", "usd"),),
    rank_by="usd",
    top_n=20,
)
TOP_ASSETS_BY_SALES_ALL_TIME = Family(
    "top_assets_by_sales_all_time",
    "asset",
    "sales",
    (("collection_top_assets_by_usd_volume", "usd"),),
    rank_by="usd",
    top_n=20,
)
TOP_ASSETS_BY_TRANSFERS_ALL_TIME = Family(
    "top_assets_by_transfers_all_time",
    "asset",
    "transfers",
    (("collection_top_assets_by_transfers", "transfers"),),
    rank_by="transfers",
    top_n=20,
)

# Metrics of the explorations, where listings are no sales; windows without
# such an event have no row.
TOTAL_VOLUME = Family("total_volume", "global", "sales", (("total_volume", "usd"),), sale_types=SOLD)
TRANSFER_TOTALS = Family(
    "transfer_totals",
    "global",
    "transfers",
    (("transfers_count", "transfers"), ("items_transferred_count", "items")),
)
TOP_COLLECTIONS_BY_VOLUME = Family(
    "top_collections_by_volume",
    "collection",
    "sales",
    (("top_collections_by_volume", "usd"),),
    rank_by="usd",
    top_n=10,
    sale_types=SOLD,
)
COLLECTION_STATS = Family(
    "collection_stats",
    "collection",
    "sales",
    (
        ("collection_floor_price", "floor_usd"),
        ("collection_total_volume", "usd"),
        ("collection_avg_assets_price", "avg_usd"),
        ("collection_total_sales", "sales"),
    ),
    sale_types=SOLD,
)

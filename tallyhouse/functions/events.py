"""Row-level predicates and expressions on clean events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.schemas import ASSET_COLUMNS, SALE_TYPES, TRANSFER_TYPE


def is_transfer() -> Column:
    return F.col("event_type") == TRANSFER_TYPE


def is_sale(sale_types: Sequence[str] = SALE_TYPES) -> Column:
    """Listings count as sales by default; pass ``("item_sold",)`` to leave them out."""
    return F.col("event_type").isin(*sale_types)


def asset_name() -> Column:
    return F.coalesce("item_name", "item_nft_id")


def asset_key() -> Column:
    """A fixed-width key over the whole asset identity, NULL fields included."""
    identity = F.to_json(F.struct(*ASSET_COLUMNS), {"ignoreNullFields": "false"})
    return F.sha1(identity.cast("binary"))

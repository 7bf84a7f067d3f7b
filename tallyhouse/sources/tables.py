"""Market events derived from the given tables.

``events`` becomes clean events, nested raw events or message text, all three
carrying the same rows; ``lineitem`` becomes a larger set of clean events.
Prices are whole numbers (or multiples of 1/2048) stored as doubles, so sums
are exact in any order and results can be compared without rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.schemas import CLEAN_COLUMNS, HEARTBEAT_EVENT

FIELDS = {
    "k": "try_cast(get_json_object(props, '$.k') as int)",
    "kind": """case event_type
        when 'purchase' then 'item_sold'
        when 'signup' then 'item_listed'
        when 'click' then 'item_transferred'
        when 'view' then 'item_received_bid'
        else 'phx_reply' end""",
    "slug": "'coll-' || cast(user_id % 15 as string)",
    "cents": "cast(floor(value * 100) as double)",
}
PRICED = "kind in ('item_sold', 'item_listed') and k % 11 <> 0"

CLEAN_SQL = {
    "event": "kind",
    "event_type": "kind",
    "collection_slug": "slug",
    "sent_at": "ts",
    "status": "if(kind = 'item_sold', 'done', 'open')",
    "item_name": "if(k % 7 = 0, null, 'item ' || cast(k as string))",
    "item_url": "'https://x.example/' || cast(k as string)",
    "item_nft_id": "'chain/' || cast(k as string)",
    "image_url": "if(k % 3 = 0, null, 'https://img.x.example/' || cast(k as string))",
    "item_blockchain": "'chain'",
    "listing_date": "if(kind = 'item_listed', ts, null)",
    "listing_type": "if(kind = 'item_listed', 'fixed', null)",
    "from_account": "'acct-' || cast(user_id as string)",
    "to_account": "if(kind = 'item_listed', null, 'acct-' || cast(k as string))",
    "payment_symbol": f"if({PRICED}, 'ETH', null)",
    "eth_price": f"if({PRICED}, cents / 2048, null)",
    "usd_price": f"if({PRICED}, cents, null)",
    "quantity": "if(k % 5 - 1 > 0, k % 5 - 1, 1)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_fields(events: DataFrame) -> DataFrame:
    return events.select("*", *[F.expr(sql).alias(name) for name, sql in FIELDS.items()])


def events_to_clean(events: DataFrame) -> DataFrame:
    return (
        _with_fields(events)
        .filter(F.col("kind") != HEARTBEAT_EVENT)
        .select(*[F.expr(CLEAN_SQL[name]).alias(name) for name in CLEAN_COLUMNS])
    )


def events_to_messages(events: DataFrame) -> DataFrame:
    """Topic-like rows ``value, timestamp``: message text and arrival time."""

    def part(name: str):
        return F.expr(CLEAN_SQL[name])

    def when_text(name: str):
        return F.date_format(part(name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    item = F.struct(
        F.struct(part("item_name").alias("name"), part("image_url").alias("image_url")).alias("metadata"),
        part("item_url").alias("permalink"),
        part("item_nft_id").alias("nft_id"),
        F.struct(part("item_blockchain").alias("name")).alias("chain"),
    )
    token = F.struct(
        part("payment_symbol").alias("symbol"),
        part("eth_price").cast("string").alias("eth_price"),
        part("usd_price").cast("string").alias("usd_price"),
    )
    inner = F.struct(
        F.expr("cast(k % 5 - 1 as bigint)").alias("quantity"),
        when_text("listing_date").alias("listing_date"),
        part("listing_type").alias("listing_type"),
        F.struct(part("collection_slug").alias("slug")).alias("collection"),
        item.alias("item"),
        F.struct(part("from_account").alias("address")).alias("from_account"),
        F.struct(part("to_account").alias("address")).alias("to_account"),
        token.alias("payment_token"),
    )
    payload = F.struct(
        part("event_type").alias("event_type"),
        when_text("sent_at").alias("sent_at"),
        part("status").alias("status"),
        inner.alias("payload"),
    )
    envelope = F.struct(
        part("event").alias("event"),
        payload.alias("payload"),
        F.concat(F.lit("collection:"), F.col("slug")).alias("topic"),
    )
    return _with_fields(events).select(
        F.to_json(envelope).alias("value"), F.col("ts").cast("timestamp").alias("timestamp")
    )


def trades_to_clean(lineitem: DataFrame) -> DataFrame:
    part = "cast(l_partkey as string)"
    columns = {
        "event": "kind",
        "event_type": "kind",
        "collection_slug": "'supp-' || cast(l_suppkey as string)",
        "sent_at": "l_shipdate",
        "status": "l_linestatus",
        "item_name": f"'part ' || {part}",
        "item_url": f"'https://x.example/' || {part}",
        "item_nft_id": f"'part/' || {part}",
        "image_url": "cast(null as string)",
        "item_blockchain": "'chain'",
        "listing_date": "cast(null as timestamp_ntz)",
        "listing_type": "cast(null as string)",
        "from_account": "'order-' || cast(l_orderkey as string)",
        "to_account": "cast(null as string)",
        "payment_symbol": "if(kind = 'item_transferred', null, 'USD')",
        "eth_price": "if(kind = 'item_transferred', null, cast(floor(l_extendedprice * 100) as double) / 2048)",
        "usd_price": "if(kind = 'item_transferred', null, cast(floor(l_extendedprice * 100) as double))",
        "quantity": "cast(l_quantity as int)",
    }
    kind = "case l_returnflag when 'A' then 'item_transferred' when 'N' then 'item_sold' else 'item_listed' end"
    return lineitem.withColumn("kind", F.expr(kind)).select(
        *[F.expr(columns[name]).alias(name) for name in CLEAN_COLUMNS]
    )


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_clean(table(spark, sf_dir, "events"))


def market_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_messages(table(spark, sf_dir, "events"))


def market_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_to_clean(table(spark, sf_dir, "lineitem"))

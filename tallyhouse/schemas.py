"""Column layouts of every table the engine reads or writes."""

from __future__ import annotations

# The field names of the marketplace's event envelope.
PAYLOAD_TYPE = """struct<
  event_type: string,
  sent_at: string,
  status: string,
  payload: struct<
    quantity: bigint,
    listing_date: string,
    listing_type: string,
    collection: struct<slug: string>,
    item: struct<
      metadata: struct<name: string, image_url: string>,
      permalink: string,
      nft_id: string,
      chain: struct<name: string>>,
    from_account: struct<address: string>,
    to_account: struct<address: string>,
    payment_token: struct<symbol: string, eth_price: string, usd_price: string>>>"""

RAW_SCHEMA = f"event string, payload {PAYLOAD_TYPE}, topic string"

# Same envelope with every leaf read as text, whatever its JSON type.
RAW_TEXT_SCHEMA = RAW_SCHEMA.replace("bigint", "string")

# The envelope with the payload left as JSON text.
ENVELOPE_SCHEMA = "event string, payload string, topic string"

# Clean column -> (path below the payload, type).
CLEAN_FIELDS = {
    "event_type": ("event_type", "string"),
    "collection_slug": ("payload.collection.slug", "string"),
    "sent_at": ("sent_at", "timestamp"),
    "status": ("status", "string"),
    "item_name": ("payload.item.metadata.name", "string"),
    "item_url": ("payload.item.permalink", "string"),
    "item_nft_id": ("payload.item.nft_id", "string"),
    "image_url": ("payload.item.metadata.image_url", "string"),
    "item_blockchain": ("payload.item.chain.name", "string"),
    "listing_date": ("payload.listing_date", "timestamp"),
    "listing_type": ("payload.listing_type", "string"),
    "from_account": ("payload.from_account.address", "string"),
    "to_account": ("payload.to_account.address", "string"),
    "payment_symbol": ("payload.payment_token.symbol", "string"),
    "eth_price": ("payload.payment_token.eth_price", "double"),
    "usd_price": ("payload.payment_token.usd_price", "double"),
    "quantity": ("payload.quantity", "int"),
}
CLEAN_COLUMNS = ["event", *CLEAN_FIELDS]

ASSET_COLUMNS = ["item_nft_id", "item_name", "item_url", "image_url"]

GLOBAL_COLUMNS = ["metric", "timestamp", "value", "collection"]
COLLECTION_COLUMNS = [
    "metric",
    "timestamp",
    "collection",
    "value",
    "asset_name",
    "asset_url",
    "image_url",
]

GLOBAL_SCHEMA = "metric string, timestamp timestamp, value double, collection string"
COLLECTION_SCHEMA = (
    "metric string, timestamp timestamp, collection string, value double, "
    "asset_name string, asset_url string, image_url string, asset_key string"
)

# Event names on the wire.
HEARTBEAT_EVENT = "phx_reply"
TRANSFER_TYPE = "item_transferred"
SALE_TYPES = ("item_sold", "item_listed")
SOLD = ("item_sold",)

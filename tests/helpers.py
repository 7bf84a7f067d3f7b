"""Small hand-made events for unit tests."""

import json
from datetime import datetime

from tallyhouse.schemas import CLEAN_COLUMNS, CLEAN_FIELDS

SCHEMA = ", ".join(["event string", *[f"{name} {kind}" for name, (_, kind) in CLEAN_FIELDS.items()]])
T0 = datetime(2024, 1, 1)


def event(kind="item_sold", slug="a", at=T0, nft="n1", name=None, usd=None, eth=None, quantity=1, **more):
    row = dict.fromkeys(CLEAN_COLUMNS)
    row.update(
        event=kind,
        event_type=kind,
        collection_slug=slug,
        sent_at=at,
        item_nft_id=nft,
        item_name=name,
        usd_price=usd,
        eth_price=eth,
        quantity=quantity,
    )
    row.update(more)
    return tuple(row[c] for c in CLEAN_COLUMNS)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def message(event="item_sold", sent_at="2024-01-01T00:10:00", quantity=1, usd="10.5", slug="a", nft="n1", **more):
    inner = {
        "quantity": quantity,
        "collection": {"slug": slug},
        "item": {"nft_id": nft, "metadata": {"name": None}},
        "payment_token": {"usd_price": usd, "eth_price": "0.5", "symbol": "ETH"},
    }
    payload = {"event_type": event, "sent_at": sent_at, "payload": inner}
    return json.dumps({"event": event, "topic": f"collection:{slug}", "payload": payload, **more})


def messages(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def by_metric(df, strip=""):
    return {r["metric"].removesuffix(strip): r["value"] for r in df.collect()}

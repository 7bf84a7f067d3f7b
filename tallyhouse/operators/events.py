"""Raw envelopes to clean, flat, typed events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.events import is_sale, is_transfer
from tallyhouse.schemas import (
    CLEAN_FIELDS,
    ENVELOPE_SCHEMA,
    HEARTBEAT_EVENT,
    PAYLOAD_TYPE,
    RAW_SCHEMA,
    RAW_TEXT_SCHEMA,
    SALE_TYPES,
)


def split_envelope(messages: DataFrame) -> DataFrame:
    """Message text to ``event, payload, topic`` strings, payload still JSON.

    One parse of the text yields all three fields.
    """
    return messages.select(_parsed_once(ENVELOPE_SCHEMA))


def parse_messages(messages: DataFrame) -> DataFrame:
    """Message text straight to the nested raw event, in one parse."""
    return messages.select(_parsed_once(RAW_SCHEMA))


def clean_events(raw: DataFrame, is_json_payload: bool = False) -> DataFrame:
    """Flatten, type and filter raw events.

    Text that does not parse as its type becomes NULL and the row stays. Rows
    whose ``event`` is NULL (unreadable lines among them) or the heartbeat go.
    """
    if is_json_payload:
        raw = raw.withColumn("payload", F.from_json("payload", PAYLOAD_TYPE))
    return (
        raw.filter(F.col("event") != HEARTBEAT_EVENT)
        .select("event", *_typed_fields())
        .withColumn("quantity", _at_least_one())
    )


def clean_messages(messages: DataFrame) -> DataFrame:
    return clean_events(parse_messages(messages))


def parse_by_path(messages: DataFrame) -> DataFrame:
    """Typed fields read from message text whatever JSON type they carry.

    Every leaf is taken as text, so a quantity sent as ``"7"`` counts as 7 here
    while the typed schema reads it as missing. No row is filtered.
    """
    envelope = F.from_json(F.col("value").cast("string"), RAW_TEXT_SCHEMA)
    return (
        messages.select(envelope["payload"].alias("payload"))
        .select(*_typed_fields())
        .withColumn("quantity", _at_least_one())
    )


def transferred_items(clean: DataFrame) -> DataFrame:
    return clean.filter(is_transfer())


def sales_items(clean: DataFrame, sale_types: Sequence[str] = SALE_TYPES) -> DataFrame:
    return clean.filter(is_sale(sale_types))


def _parsed_once(schema: str) -> Column:
    """The fields of the message text. As a generator's output they are not
    recomputed by a filter above, as a plain expression's would be."""
    return F.inline(F.array(F.from_json(F.col("value").cast("string"), schema)))


def _typed_fields() -> list[Column]:
    return [
        F.col(f"payload.{path}").try_cast(kind).alias(name)
        for name, (path, kind) in CLEAN_FIELDS.items()
    ]


def _at_least_one() -> Column:
    quantity = F.col("quantity")
    return F.when(quantity > 0, quantity).otherwise(1)

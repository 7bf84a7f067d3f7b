from datetime import datetime

import pytest

from helpers import message, messages, values
from tallyhouse.operators.events import (
    clean_events,
    clean_messages,
    parse_by_path,
    parse_messages,
    sales_items,
    split_envelope,
    transferred_items,
)
from tallyhouse.schemas import CLEAN_COLUMNS


def both_ways(spark, *texts):
    """Nested and JSON-payload cleaning must agree; return the rows."""
    source = messages(spark, *texts)
    nested = clean_events(parse_messages(source))
    text = clean_events(split_envelope(source), is_json_payload=True)
    assert nested.columns == text.columns == CLEAN_COLUMNS
    assert values(nested, *CLEAN_COLUMNS) == values(text, *CLEAN_COLUMNS)
    return nested


def test_corrupt_and_eventless_and_heartbeat_rows_are_dropped(spark):
    df = both_ways(spark, "{not json", '{"topic": "x"}', message(event="phx_reply"), message())
    assert values(df, "event") == [("item_sold",)]


@pytest.mark.parametrize("quantity", [None, 0, -3, "7", 4294967301])
def test_quantity_falls_back_to_one(spark, quantity):
    assert values(both_ways(spark, message(quantity=quantity)), "quantity") == [(1,)]


def test_positive_quantity_is_kept(spark):
    assert values(both_ways(spark, message(quantity=5)), "quantity") == [(5,)]


def test_unreadable_price_and_time_become_null_and_the_row_stays(spark):
    df = both_ways(spark, message(usd="abc", sent_at="never"))
    assert values(df, "usd_price", "eth_price", "sent_at") == [(None, 0.5, None)]


def test_times_with_and_without_zone(spark):
    df = both_ways(spark, message(sent_at="2024-01-01T02:00:00+02:00"), message(sent_at="2024-01-01T00:00:00.5"))
    assert values(df, "sent_at") == [
        (datetime(2024, 1, 1),),
        (datetime(2024, 1, 1, 0, 0, 0, 500000),),
    ]


def test_unknown_fields_are_ignored(spark):
    assert both_ways(spark, message(ref=7)).count() == 1


def test_parse_by_path_reads_text_of_any_type_and_keeps_all_rows(spark):
    df = parse_by_path(messages(spark, message(quantity="7"), message(event="phx_reply", quantity=2)))
    assert values(df, "event_type", "quantity") == [("item_sold", 7), ("phx_reply", 2)]


def test_sales_and_transfers(spark):
    kinds = ["item_sold", "item_listed", "item_transferred", "item_received_bid"]
    clean = clean_messages(messages(spark, *[message(event=k) for k in kinds]))
    assert values(sales_items(clean), "event_type") == [("item_listed",), ("item_sold",)]
    assert values(sales_items(clean, ("item_sold",)), "event_type") == [("item_sold",)]
    assert values(transferred_items(clean), "event_type") == [("item_transferred",)]

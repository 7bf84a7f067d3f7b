from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from helpers import T0, by_metric, event, events, values
from tallyhouse.operators import catalogue as C
from tallyhouse.operators.catalogue import Family
from tallyhouse.operators.metrics import metric_rows
from tallyhouse.plans import families as fam

AS_OF = datetime(2024, 2, 1)
H = timedelta(hours=1)


def test_global_window_sums_prices_of_sales_only(spark):
    clean = events(
        spark,
        event(usd=5.0, eth=1.0),
        event("item_listed", usd=2.0, eth=0.5),
        event("item_transferred", usd=100.0, quantity=3),
        event("item_received_bid", usd=50.0),
    )
    rows = by_metric(fam.global_metrics(clean, "1 hour"), "__1_hour")
    assert rows == {
        "total_number_of_events": 4.0,
        "total_transfers": 1.0,
        "total_items_transferred": 3.0,
        "total_sales": 2.0,
        "total_eth_volume": 1.5,
        "total_usd_volume": 7.0,
    }


def test_listings_can_be_left_out_of_sales(spark):
    clean = events(spark, event(usd=5.0), event("item_listed", usd=2.0))
    rows = by_metric(fam.global_metrics(clean, "1 hour", sale_types=("item_sold",)), "__1_hour")
    assert (rows["total_sales"], rows["total_usd_volume"]) == (1.0, 5.0)


def test_unpriced_sales_are_zero_globally_and_null_per_collection(spark):
    clean = events(spark, event(usd=None))
    assert by_metric(fam.global_metrics(clean, "1 hour"))["total_usd_volume__1_hour"] == 0.0
    sales = by_metric(fam.collection_sales(clean, "1 hour"), "__1_hour")
    assert sales["collection_total_usd_volume"] is None
    assert sales["collection_floor_assets_usd_price"] is None
    assert sales["collection_total_sales_count"] == 1.0
    all_time = by_metric(fam.collection_all_time(clean, as_of=AS_OF), "__all_time")
    assert all_time["collection_total_usd_volume"] == 0.0
    assert all_time["collection_avg_assets_usd_price"] is None


def test_window_label_is_its_end_and_windows_are_half_open(spark):
    clean = events(spark, event(at=T0 + H), event(at=T0 + H - timedelta(microseconds=1)))
    rows = fam.global_metrics(clean, "1 hour").filter("metric = 'total_sales__1_hour'")
    assert values(rows, "timestamp", "value") == [(T0 + H, 1.0), (T0 + 2 * H, 1.0)]


def test_fourteen_day_windows_are_aligned_to_the_epoch(spark):
    rows = fam.global_metrics(events(spark, event()), "14 days")
    assert values(rows, "timestamp")[0] == (datetime(2024, 1, 4),)


def test_sliding_windows_count_an_event_in_each(spark):
    rows = fam.global_metrics(events(spark, event(at=T0 + H)), "1 hour", "30 minutes")
    rows = rows.filter("metric = 'total_sales__1_hour'")
    assert values(rows, "timestamp") == [(T0 + 1.5 * H,), (T0 + 2 * H,)]


def test_events_without_a_time_count_only_in_all_time(spark):
    clean = events(spark, event(at=None))
    assert fam.global_metrics(clean, "1 hour").count() == 0
    assert by_metric(fam.global_all_time(clean, as_of=AS_OF))["total_sales__all_time"] == 1.0


@pytest.mark.parametrize("build", [fam.global_all_time, lambda c, as_of: fam.global_feed(c, "all time", as_of=as_of)])
def test_all_time_totals_exist_over_no_events(spark, build):
    rows = by_metric(build(events(spark, event()).limit(0), as_of=AS_OF), "__all_time")
    assert rows == {
        "total_number_of_events": 0.0,
        "total_transfers": 0.0,
        "total_items_transferred": None,
        "total_sales": 0.0,
        "total_eth_volume": None,
        "total_usd_volume": None,
    }


def test_one_sided_collections_keep_null_on_the_other_side(spark):
    clean = events(spark, event("item_transferred", "t", quantity=2), event("item_received_bid", "bids"))
    rows = fam.collection_all_time(clean, as_of=AS_OF)
    assert {r["collection"] for r in rows.collect()} == {"t"}
    got = by_metric(rows, "__all_time")
    assert got["collection_total_transfers"] == 1.0
    assert got["collection_total_items_transferred"] == 2.0
    assert all(got[f"collection_{m}"] is None for m in ("total_sales_count", "total_assets_sold", "total_usd_volume"))


def test_null_collection_is_one_group(spark):
    clean = events(spark, event(slug=None, usd=1.0), event("item_transferred", slug=None))
    rows = fam.collection_all_time(clean, as_of=AS_OF)
    assert rows.count() == 8
    assert by_metric(rows)["collection_total_transfers__all_time"] == 1.0


def test_ties_at_the_last_rank_go_to_the_lower_name(spark):
    clean = events(spark, *[event(slug=f"c{i:02d}", usd=1.0) for i in range(12)])
    rows = fam.top_collections_by_sales(clean, "1 hour").filter("metric like '%usd_volume%'")
    assert [c for (c,) in values(rows, "collection")] == [f"c{i:02d}" for i in range(10)]


def test_unpriced_groups_rank_last(spark):
    clean = events(spark, event(slug="a"), event(slug="b", usd=1.0))
    rows = fam.top_collections_all_time(clean, n=1, as_of=AS_OF)
    assert values(rows, "collection", "value") == [("b", 1.0)]


def test_top_assets_are_ranked_within_their_collection(spark):
    rows = [event(slug=s, nft=f"n{i:03d}", usd=float(i)) for s in ("a", "b") for i in range(30)]
    top = fam.top_assets_by_sales(events(spark, *rows), "1 hour")
    expected = sorted(float(i) for i in range(10, 30))
    for slug in ("a", "b"):
        got = [v for (v,) in values(top.filter(f"collection = '{slug}'"), "value")]
        assert sorted(got) == expected


@pytest.mark.parametrize("n", [1000, 1500])
def test_rankings_beyond_the_group_limit_are_exact(spark, n):
    spread = [event(slug="hot", nft=f"n{i:05d}", usd=float(i)) for i in range(2000)]
    top = fam.top_assets_by_sales(events(spark, *spread), "1 hour", n=n)
    got = sorted(v for (v,) in values(top, "value"))
    assert got == [float(i) for i in range(2000 - n, 2000)]


def test_asset_name_falls_back_to_its_id(spark):
    rows = fam.asset_transfers(events(spark, event("item_transferred"), event("item_transferred", nft="n2", name="x")), "1 hour")
    assert values(rows, "asset_name") == [("n1",), ("x",)]


def test_assets_that_differ_in_one_field_have_different_keys(spark):
    clean = events(spark, event("item_transferred"), event("item_transferred", item_url=""))
    rows = fam.asset_transfers(clean, "1 hour", with_asset_key=True)
    assert len(set(values(rows, "asset_key"))) == 2


@pytest.mark.parametrize("grain", ["1 hour", "1 day", "all time"])
def test_feeds_equal_their_families_run_alone(spark, grain):
    rows = [
        event(kind, f"c{i % 13}", T0 + i * timedelta(minutes=7), f"n{i % 31}", usd=float(i % 17) if i % 5 else None, quantity=i % 4 + 1)
        for i in range(600)
        for kind in ("item_sold", "item_transferred", "item_received_bid")
        if (i + len(kind)) % 3
    ]
    clean = events(spark, *rows)
    if grain == "all time":
        alone = fam.global_all_time(clean, AS_OF).unionByName(fam.top_collections_all_time(clean, as_of=AS_OF))
        assets = fam.collection_all_time(clean, AS_OF).unionByName(fam.top_assets_all_time(clean, 5, AS_OF))
        feeds = fam.global_feed(clean, grain, as_of=AS_OF), fam.collections_feed(clean, grain, as_of=AS_OF, n_per_collection=5)
    else:
        alone = fam.global_metrics(clean, grain)
        alone = alone.unionByName(fam.top_collections_by_sales(clean, grain))
        alone = alone.unionByName(fam.top_collections_by_transfers(clean, grain))
        assets = fam.collection_sales(clean, grain).unionByName(fam.collection_transactions(clean, grain))
        assets = assets.unionByName(fam.top_assets_by_sales(clean, grain)).unionByName(fam.asset_transfers(clean, grain))
        feeds = fam.global_feed(clean, grain), fam.collections_feed(clean, grain)
    for shared, separate in zip(feeds, (alone, assets)):
        assert values(shared, *shared.columns) == values(separate, *shared.columns)


def test_a_user_can_register_a_metric(spark):
    family = Family("busy", "collection", "events", (("collection_total_events", "events"),), "events", 1)
    clean = events(spark, event(slug="a"), event("item_received_bid", "b"), event("item_received_bid", "b"))
    rows = metric_rows(clean, [family], "1 day")
    assert values(rows, "metric", "collection", "value") == [("collection_total_events__1_day", "b", 2.0)]


def test_unranked_assets_do_not_ride_through_a_ranking(spark):
    with pytest.raises(ValueError):
        metric_rows(events(spark, event()), [C.ASSET_TRANSFERS, C.TOP_ASSETS_BY_SALES], "1 hour")


def test_families_may_keep_different_numbers(spark):
    clean = events(spark, *[event(slug=f"c{i}", usd=float(i)) for i in range(5)], *[event("item_transferred", f"c{i}") for i in range(5)])
    families = [
        replace(C.TOP_COLLECTIONS_BY_SALES_ALL_TIME, top_n=1),
        replace(C.TOP_COLLECTIONS_BY_TRANSFERS_ALL_TIME, top_n=3),
    ]
    counts = {}
    for (metric,) in values(metric_rows(clean, families, as_of=AS_OF), "metric"):
        counts[metric] = counts.get(metric, 0) + 1
    assert sorted(counts.values()) == [1, 3]

from datetime import datetime, timedelta

from helpers import T0, event, events, values
from tallyhouse.operators import explore
from tallyhouse.plans import families as fam
from tallyhouse.sinks.archive import write_archive

H = timedelta(hours=1)


def test_a_sale_on_the_boundary_falls_in_one_window(spark):
    clean = events(spark, event(at=T0, usd=1.0), event(at=T0 + H, usd=2.0), event(at=None, usd=3.0))
    rows = explore.sales_in_top_windows(clean, "1 hour")
    assert values(rows, "usd_price", "window_start") == [(1.0, T0), (2.0, T0 + H), (3.0, None)]


def test_sales_outside_the_top_windows_keep_null_bounds(spark):
    """Collection b tops the second hour only; its first sale is still listed."""
    clean = events(
        spark,
        event(slug="a", at=T0, usd=9.0),
        event(slug="b", at=T0, usd=1.0),
        event(slug="b", at=T0 + H, usd=1.0),
        event(slug="c", at=T0, usd=2.0),
    )
    rows = explore.sales_in_top_windows(clean, "1 hour", top_n=1)
    assert values(rows, "collection_slug", "window_start") == [("a", T0), ("b", None), ("b", T0 + H)]
    assert {r["collection_slug"] for r in explore.sales_of_top_collections(clean, "1 hour", 1).collect()} == {"a", "b"}


def test_only_sold_items_count_and_unnamed_collections_do_not(spark):
    clean = events(spark, event(usd=1.0), event("item_listed", usd=9.0), event(slug=None, usd=9.0))
    assert values(explore.sales_of_top_collections(clean, "1 hour"), "usd_price") == [(1.0,)]
    stats = explore.top_collection_stats(clean, "1 hour")
    assert values(stats, "metric", "value") == [
        ("collection_avg_assets_price__1_hour", 1.0),
        ("collection_floor_price__1_hour", 1.0),
        ("collection_total_sales__1_hour", 1.0),
        ("collection_total_volume__1_hour", 1.0),
    ]


def test_dearest_sales_per_collection_and_window(spark):
    clean = events(spark, *[event(slug=s, at=T0 + H * (i % 2), usd=float(i)) for s in "ab" for i in range(10)])
    rows = explore.top_sales_by_price(clean, "1 hour", n=2)
    assert [v for (v,) in values(rows.filter("collection = 'a'"), "value")] == [6.0, 7.0, 8.0, 9.0]
    # Both collections sell the same here, so the name decides which one is on top.
    assert {r["collection"] for r in explore.top_sales_by_price(clean, "1 hour", 2, top_n=1).collect()} == {"a"}


def test_assets_by_transfers_come_ranked_and_unranked(spark):
    rows = [event("item_transferred", nft=f"n{i:02d}") for i in range(30) for _ in range(i % 3 + 1)]
    clean = events(spark, *rows)
    assert fam.asset_transfers(clean, "1 day").count() == 30
    top = values(fam.top_assets_by_transfers(clean, "1 day", n=10), "asset_name", "value")
    assert top == [(f"n{i:02d}", 3.0) for i in range(2, 30, 3)]


def test_a_range_excludes_its_start_and_includes_its_end(spark):
    clean = events(spark, *[event(at=T0 + H * i, quantity=i + 1) for i in range(3)])
    row = explore.range_profile(clean, T0, T0 + 2 * H).first()
    assert (row["first_event_at"], row["last_event_at"]) == (T0 + H, T0 + 2 * H)
    assert (row["count"], row["total_number_of_assets"]) == (2, 5)


def test_summary_of_values(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 5)] + [(None,)], "value double")
    row = explore.metric_summary(rows).first()
    assert (row["count"], row["null_count"], row["mean"], row["min"], row["max"]) == (4, 1, 2.5, 1.0, 4.0)
    assert row["quartiles"] == [1.0, 2.0, 3.0]


def test_quartiles_of_values(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 5)] + [(None,)], "value double")
    assert tuple(explore.metric_quartiles(rows).first()) == (1.75, 2.5, 3.25)


def test_archive_files_roll_by_size(spark, tmp_path):
    rows = spark.createDataFrame([("{}", datetime(2024, 1, 1))] * 10, "value string, timestamp timestamp")
    write_archive(rows.coalesce(1), str(tmp_path / "a"), max_records_per_file=4)
    assert len(list((tmp_path / "a").rglob("*.gz"))) == 3

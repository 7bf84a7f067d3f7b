"""The shape of the physical plans, and what AQE does with a hot key."""

import re

import pytest

from helpers import T0, event, events
from tallyhouse.operators import explore
from tallyhouse.plans import families as fam
from tallyhouse.session import conf


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan: str) -> int:
    return len(re.findall(r"FileScan|LocalTableScan|Scan ExistingRDD|BatchScan", plan))


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "clean")
    kinds = ["item_sold", "item_listed", "item_transferred", "item_received_bid"]
    rows = [event(kinds[i % 4], f"c{i % 5}", T0, f"n{i % 7}", usd=float(i)) for i in range(100)]
    events(spark, *rows).write.parquet(path)
    return spark.read.parquet(path)


def test_feeds_share_scans_and_limit_groups_before_the_shuffle(clean):
    plan = physical(fam.global_feed(clean, "1 hour"))
    assert scans(plan) == 1
    assert plan.count("Exchange hashpartitioning") == 2
    assert re.search(r"WindowGroupLimit .*Partial", plan)
    plan = physical(fam.collections_feed(clean, "1 hour"))
    assert scans(plan) == 4
    assert plan.count("Exchange hashpartitioning") == 5
    plan = physical(fam.collections_feed(clean, "all time"))
    assert scans(plan) == 2
    assert plan.count("Exchange hashpartitioning") == 3


@pytest.mark.parametrize(
    "build",
    [
        lambda c: fam.global_feed(c, "1 hour"),
        lambda c: fam.collections_feed(c, "1 hour"),
        lambda c: fam.collections_feed(c, "all time"),
        lambda c: explore.sales_in_top_windows(c, "1 hour", 10),
        lambda c: explore.top_sales_by_price(c, "1 hour"),
    ],
)
def test_plans_stay_in_the_jvm_with_no_cross_join(clean, build):
    plan = physical(build(clean))
    assert "Python" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(clean):
    plan = physical(fam.collection_sales(clean, "1 hour"))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "In(event_type" in scan
    schema = scan.split("ReadSchema:")[1]
    assert all(c in schema for c in ("collection_slug", "sent_at", "usd_price", "quantity"))
    assert all(c not in schema for c in ("item_name", "image_url", "eth_price", "to_account"))


@pytest.mark.parametrize("build", [explore.sales_of_top_collections, explore.sales_in_top_windows])
def test_a_hot_collection_is_split_by_the_join(spark, tmp_path, build):
    """One collection sends most sales: AQE splits its side of the join."""
    hot = [event(slug="hot", nft=f"n{i}", usd=float(i)) for i in range(20000)]
    cold = [event(slug=f"c{i}", nft="n", usd=1.0) for i in range(500)]
    path = str(tmp_path / "clean")
    events(spark, *hot, *cold).repartition(8).write.parquet(path)
    clean = spark.read.parquet(path)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    with conf(spark, settings):
        joined = build(clean, "1 hour", top_n=10)
        assert len(joined.collect()) == 20000 + 9
        joins = re.findall(r"SortMergeJoin\S*", physical(joined).split("Initial Plan")[0])
        assert joins and all("skew=true" in j for j in joins)

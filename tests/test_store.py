from datetime import datetime, timedelta

import pytest

from helpers import T0, event, events, values
from tallyhouse.plans import families as fam
from tallyhouse.schemas import COLLECTION_COLUMNS, COLLECTION_SCHEMA, GLOBAL_SCHEMA
from tallyhouse.serving import reads
from tallyhouse.session import conf
from tallyhouse.sinks import snapshots, store
from tallyhouse.sinks.messages import decode_messages, encode_messages, stored_rows, topic_writer, write_topic
from tallyhouse.sinks.snapshots import SnapshotList
from tallyhouse.sources.topics import message_file_stream
from tallyhouse.streaming import jobs

H = timedelta(hours=1)


def metric_rows(spark, *rows):
    return spark.createDataFrame(list(rows), GLOBAL_SCHEMA)


def test_the_last_write_of_a_key_wins(spark, tmp_path):
    path = str(tmp_path)
    store.write_metrics(metric_rows(spark, ("m", T0, 1.0, ""), ("m", T0 + H, 1.0, "")), path, run=1, batch=0)
    store.write_metrics(metric_rows(spark, ("m", T0, 2.0, "")), path, run=1, batch=1)
    assert values(store.read_metrics(spark, path), "timestamp", "value") == [(T0, 2.0), (T0 + H, 1.0)]
    # A later run replaces a higher batch of an earlier one.
    store.write_metrics(metric_rows(spark, ("m", T0, 3.0, "")), path, run=2, batch=0)
    assert values(store.read_metrics(spark, path), "value") == [(1.0,), (3.0,)]


def test_batches_are_ordered_as_numbers(spark, tmp_path):
    path = str(tmp_path)
    for batch in (9, 10):
        store.write_metrics(metric_rows(spark, ("m", T0, float(batch), "")), path, run=0, batch=batch)
    assert values(store.read_metrics(spark, path), "value") == [(10.0,)]


def test_a_retried_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path)
    for _ in range(2):
        store.write_metrics(metric_rows(spark, ("m", T0, 1.0, "")), path, run=0, batch=7)
    assert store._read_all(spark, path).count() == 1


def test_two_assets_of_one_window_both_survive(spark, tmp_path):
    clean = events(spark, event(nft="x", usd=1.0), event(nft="y", usd=2.0))
    rows = fam.top_assets_by_sales(clean, "1 hour", with_asset_key=True)
    store.write_metrics(rows, str(tmp_path), run=0)
    stored = store.read_metrics(spark, str(tmp_path))
    assert values(stored, *COLLECTION_COLUMNS) == values(rows, *COLLECTION_COLUMNS)


def test_rows_without_a_collection_are_rejected_by_the_store(spark, tmp_path):
    clean = events(spark, event(slug=None, usd=1.0), event(usd=2.0))
    store.write_metrics(fam.collection_sales(clean, "1 hour", with_asset_key=True), str(tmp_path), run=0)
    assert {r["collection"] for r in store.read_metrics(spark, str(tmp_path)).collect()} == {"a"}
    assert store.read_rejects(spark, str(tmp_path)).count() == 5


def test_stream_then_batch_then_stream(spark, tmp_path):
    path = str(tmp_path)
    for run, batch, value in (("stream-a", 5, 1.0), ("batch-b", 0, 2.0), ("stream-a", 6, 9.0)):
        store.write_metrics(metric_rows(spark, ("m", T0, value, "")), path, run, batch)
        assert values(store.read_metrics(spark, path), "value") == [(value,)]


def test_two_writers_keep_their_folders(spark, tmp_path):
    path = str(tmp_path)
    store.write_metrics(metric_rows(spark, ("m__1_minute", T0, 1.0, "")), path, "stream-a", 0)
    store.write_metrics(metric_rows(spark, ("m__5_minutes", T0, 2.0, "")), path, "stream-b", 0)
    assert values(store.read_metrics(spark, path), "value") == [(1.0,), (2.0,)]


def test_compaction_keeps_the_newest_rows_and_their_order(spark, tmp_path):
    path = str(tmp_path)
    store.write_metrics(metric_rows(spark, ("m", T0, 1.0, ""), (None, T0, 7.0, "")), path, run=1, batch=0)
    store.write_metrics(metric_rows(spark, ("m", T0, 2.0, "")), path, run=1, batch=5)
    assert store.compact_metrics(spark, path)
    assert not store.compact_metrics(spark, path)
    assert store._read_all(spark, path).filter("kept").count() == 1
    assert [r["reason"] for r in store.read_rejects(spark, path).collect()] == ["a key column is null"]
    store.write_metrics(metric_rows(spark, ("m", T0, 0.0, "")), path, run=2, batch=4)
    assert values(store.read_metrics(spark, path), "value") == [(0.0,)]


def folders(path):
    return sorted(str(p.relative_to(path)) for p in path.glob("rows/*/*"))


def test_compactions_go_on_while_others_read_and_write(spark, tmp_path):
    """A reader that listed before a compaction finishes after it; the list and the folders stay few."""
    expected, path = {}, str(tmp_path)
    for i in range(8):
        rows = [(f"m{i % 3}", T0 + (j % 5) * H, float(10 * i + j), "") for j in range(i, i + 3)]
        expected.update({r[:2]: r[2] for r in rows})
        store.write_metrics(metric_rows(spark, *rows), path, "stream", i)
        reader = store.read_metrics(spark, path)
        before = dict(expected)
        if i % 2:
            store.compact_metrics(spark, path)
        assert {(r["metric"], r["timestamp"]): r["value"] for r in reader.collect()} == before
        assert len(list((tmp_path / "_list").glob("[!.]*"))) <= 8
    assert {(r["metric"], r["timestamp"]): r["value"] for r in store.read_metrics(spark, path).collect()} == expected
    store.compact_metrics(spark, path, everything=True)
    store.write_metrics(metric_rows(spark, ("m9", T0, 1.0, "")), path, "stream", 9)
    store.compact_metrics(spark, path, everything=True)
    state = SnapshotList(spark, path).state()
    assert len(state.folders) == 1 and len(folders(tmp_path)) <= 4
    assert store.read_metrics(spark, path).count() == len(expected) + 1


def test_a_row_is_not_rewritten_by_each_compaction(spark, tmp_path):
    path, sizes = str(tmp_path), []
    for i in range(12):
        rows = [("m", T0 + (4 * i + j) * H, 1.0, "") for j in range(4)]
        store.write_metrics(metric_rows(spark, *rows), path, "w", i)
        store.compact_metrics(spark, path)
        sizes.append(len(SnapshotList(spark, path).state().folders))
    assert 1 < max(sizes) <= 4
    assert store.read_metrics(spark, path).count() == 48


def test_a_crashed_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    for i in range(3):
        store.write_metrics(metric_rows(spark, ("m", T0, float(i), "")), path, "w", i)
        store.compact_metrics(spark, path, everything=True)
    store.write_metrics(metric_rows(spark, ("m", T0, 3.0, "")), path, "w", 3)
    real = snapshots.SnapshotList._delete_files
    monkeypatch.setattr(snapshots.SnapshotList, "_delete_files", lambda self, names: None)  # ends before it cleans up
    store.compact_metrics(spark, path)
    assert values(store.read_metrics(spark, path), "value") == [(3.0,)]
    monkeypatch.setattr(snapshots.SnapshotList, "_delete_files", real)
    store.write_metrics(metric_rows(spark, ("m", T0, 4.0, "")), path, "w", 4)
    store.compact_metrics(spark, path)
    assert values(store.read_metrics(spark, path), "value") == [(4.0,)]
    store.write_metrics(metric_rows(spark, ("m", T0, 5.0, "")), path, "w", 5)
    monkeypatch.setattr(store, "_write_files", lambda rows, folder: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.compact_metrics(spark, path)
    assert not list((tmp_path / "_list").glob("claim.*"))
    assert values(store.read_metrics(spark, path), "value") == [(5.0,)]


def test_one_compaction_at_a_time(spark, tmp_path):
    path = str(tmp_path)
    store.write_metrics(metric_rows(spark, ("m", T0, 1.0, "")), path, "w", 0)
    lists = SnapshotList(spark, path)
    lists.claim(1)
    with pytest.raises(RuntimeError, match="claimed"):
        store.compact_metrics(spark, path)
    lists.give_up(1)
    assert store.compact_metrics(spark, path)


def test_folders_of_dead_writes_are_swept_when_old(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    store.write_metrics(metric_rows(spark, ("m", T0, 1.0, "")), path, "w", 0)
    metric_rows(spark, ("m", T0, 1.0, "")).write.parquet(f"{path}/rows/writer=dead/write=0.1")
    store.compact_metrics(spark, path)
    assert "rows/writer=dead/write=0.1" in folders(tmp_path)
    monkeypatch.setattr(snapshots, "PATIENCE", -1)
    store.write_metrics(metric_rows(spark, ("m", T0, 2.0, "")), path, "w", 1)
    store.compact_metrics(spark, path, everything=True)
    assert "rows/writer=dead/write=0.1" not in folders(tmp_path)
    assert values(store.read_metrics(spark, path), "value") == [(2.0,)]


def test_a_write_of_nothing_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.read_metrics(spark, path).collect() == []
    assert store.write_metrics(metric_rows(spark).limit(0), path, "w", 0) == 0
    assert SnapshotList(spark, path).state().folders == []
    assert not store.compact_metrics(spark, path)


def scan_metrics(rows):
    """Rows and files that the scans of a plan read."""
    rows._jdf.collectToPython()
    plan = rows._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).collectLeaves()
    found = {"numOutputRows": 0, "numFiles": 0}
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.plan() if "QueryStage" in leaf.nodeName() else leaf
        inner = leaf.collectLeaves()
        for j in range(inner.size()):
            metrics = inner.apply(j).metrics()
            for name in found:
                if metrics.contains(name):
                    found[name] += metrics.apply(name).value()
    return found


def test_a_read_opens_one_metric_and_few_row_groups(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(60_000).selectExpr(
        "concat('m', id % 3) as metric", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id div 300) as timestamp",
        "concat('c', lpad(id % 100, 3, '0')) as collection", "cast(id as double) as value",
    )
    store.write_metrics(rows, path, "w", 0)
    with conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}):
        store.compact_metrics(spark, path)
    whole = scan_metrics(store.read_metrics(spark, path))
    one = scan_metrics(store.read_metrics(spark, path).filter("metric = 'm1'"))
    point = store.read_metrics(spark, path).filter("metric = 'm1' and collection = 'c040' and timestamp >= '2024-01-01'")
    narrow = scan_metrics(point)
    assert one["numFiles"] < whole["numFiles"] and one["numOutputRows"] == 20_000
    assert 0 < narrow["numOutputRows"] < 10_000
    assert point.count() == 200


# Messages to the table


def test_messages_fill_the_table_and_the_rest_is_rejected(spark, tmp_path):
    clean = events(spark, event(nft="x", usd=1.0), event(nft="y", usd=2.0), event(slug="b", nft="x", usd=4.0))
    rows = fam.collections_feed(clean, "1 hour", with_asset_key=True)
    good = [r["value"] for r in encode_messages(rows).collect()]
    bad = ["no json", '{"metric": "m"}', '{"metric": "m", "timestamp": "2024-01-01T00:00:00Z", "value": 1}', "{}", '{"metric": 7, "timestamp": "yesterday", "collection": "a"}']
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    for i, texts in enumerate((good[::2] + bad[:3], good[1::2], bad[3:] + good[:3])):
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(folder)
        writer = jobs.messages_to_store(message_file_stream(spark, folder, 1), table, checkpoint)
        jobs.run_available(writer, spark, state_partitions=2, timeout=300)
        assert len(SnapshotList(spark, table).state().writes) == i + 1
    stored = store.read_metrics(spark, table)
    assert values(stored, *COLLECTION_COLUMNS, "asset_key") == values(rows, *COLLECTION_COLUMNS, "asset_key")
    assert stored.filter("asset_key <> ''").select("asset_key").distinct().count() == 2
    rejects = store.read_rejects(spark, table)
    assert sorted(r["message"] for r in rejects.collect()) == sorted(bad)
    assert {r["reason"] for r in rejects.collect()} == {"no metric", "no timestamp", "no collection"}


def test_keyed_and_older_messages(spark):
    rows = fam.collections_feed(events(spark, event(nft="x", usd=1.0), event(nft="y", usd=2.0)), "1 hour", with_asset_key=True)
    keyed = stored_rows(encode_messages(rows, key_column="collection"), key_column="collection")
    assert values(keyed, *COLLECTION_COLUMNS, "asset_key") == values(rows, *COLLECTION_COLUMNS, "asset_key")
    older = stored_rows(encode_messages(rows.drop("asset_key"))).filter("metric like 'collection_top_assets%'")
    assert older.filter("reason is null and asset_key <> ''").count() == older.count()
    assert older.select("metric", "asset_name", "asset_key").distinct().groupBy("metric").count().agg({"count": "max"}).first()[0] == 2
    tomb = spark.createDataFrame([(None,)], "value string")
    assert stored_rows(tomb).first()["reason"] == "no message"


def test_a_metric_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path)
    store.write_metrics(metric_rows(spark, ("m", T0, 1.0, ""), ("n", T0, 1.0, "")), path, run=0)
    plan = store.read_metrics(spark, path).filter("metric = 'm'")._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "metric" in scan.split("PartitionFilters:")[1].split("]")[0]


def test_messages_keep_null_fields_and_take_the_key_out(spark):
    rows = fam.collection_sales(events(spark, event(usd=None)), "1 hour")
    texts = [r["value"] for r in encode_messages(rows).collect()]
    assert all('"asset_name":null' in t for t in texts)
    keyed = encode_messages(rows, key_column="collection")
    assert keyed.columns == ["key", "value"]
    assert all(r["key"] == "a" and '"collection"' not in r["value"] for r in keyed.collect())
    back = decode_messages(encode_messages(rows), COLLECTION_SCHEMA)
    assert values(back, *COLLECTION_COLUMNS) == values(rows, *COLLECTION_COLUMNS)


def test_topics_need_a_name_and_the_kafka_package(spark):
    rows = metric_rows(spark, ("m", T0, 1.0, ""))
    with pytest.raises(Exception, match="kafka"):
        write_topic(rows, "t", "nowhere:1")
    with pytest.raises(ValueError):
        topic_writer(rows, "", "nowhere:1", "/tmp/none")


# Reads


@pytest.fixture
def stored(spark):
    return metric_rows(
        spark,
        *[
            (f"{name}__{grain}", T0 + i * H, float(i), collection)
            for name in ("volume", "count")
            for grain in ("1_hour", "1_day")
            for i in range(3)
            for collection in ("", "b")
        ],
    )


@pytest.fixture
def stored_collections(spark):
    return spark.createDataFrame(
        [
            (f"{name}__1_hour", T0 + i * H, collection, float(i), None, None, None, "")
            for name in ("volume", "count")
            for i in range(3)
            for collection in ("a", "b")
        ],
        COLLECTION_SCHEMA,
    )


def test_reading_without_filters_returns_everything(stored, stored_collections):
    assert reads.read_global(stored).count() == 24
    assert reads.read_collection(stored_collections).count() == 12


@pytest.mark.parametrize("only", [{"metric": "volume"}, {"grain": "1 hour"}])
def test_metric_and_grain_go_together(stored, stored_collections, only):
    with pytest.raises(ValueError):
        reads.read_global(stored, **only)
    with pytest.raises(ValueError):
        reads.read_collection(stored_collections, collection="a", **only)


def test_collection_metric_and_grain_go_together(stored_collections):
    with pytest.raises(ValueError):
        reads.read_collection(stored_collections, collection="a")
    with pytest.raises(ValueError):
        reads.read_collection(stored_collections, metric="volume", grain="1 hour")


def test_filters_and_key_order(stored, stored_collections):
    got = [tuple(r) for r in reads.read_global(stored, "volume", "1 hour").select("collection", "timestamp").collect()]
    assert got == [(c, T0 + i * H) for c in ("", "b") for i in (2, 1, 0)]
    rows = reads.read_collection(stored_collections, "a", "volume", "1 hour").collect()
    assert [r["timestamp"] for r in rows] == [T0 + 2 * H, T0 + H, T0]
    assert {r["metric"] for r in rows} == {"volume__1_hour"}


def test_time_bounds_are_included(stored):
    rows = reads.read_global(stored, "volume", "1 hour", from_ts=T0 + H, to_ts=T0 + 2 * H)
    assert {r["timestamp"] for r in rows.collect()} == {T0 + H, T0 + 2 * H}


@pytest.mark.parametrize("limit, expected", [(10, 10), (0, 24), (None, 24)])
def test_limit(stored, limit, expected):
    assert reads.read_global(stored, limit=limit).count() == expected


@pytest.mark.parametrize("ascending", [True, False])
def test_order_by_time(stored, stored_collections, ascending):
    for rows in (
        reads.read_global(stored, order_ascending=ascending),
        reads.read_collection(stored_collections, order_ascending=ascending),
    ):
        times = [r["timestamp"] for r in rows.collect()]
        assert times == sorted(times, reverse=not ascending)


def test_windowed_asset_volume_has_one_name(spark):
    assert reads.stored_name("collection_top_assets_by_usd_volume", "1 day") == (
        "collection_top_assets_by_sales_volume__1_day"
    )
    assert reads.stored_name("collection_top_assets_by_usd_volume", "all_time") == (
        "collection_top_assets_by_usd_volume__all_time"
    )


def test_latest_per_group_keeps_ties_and_drops_older_rows(spark):
    rows = metric_rows(spark, ("m", T0, 9.0, "a"), ("m", T0 + H, 1.0, "a"), ("m", T0 + H, 2.0, "a"), ("m", T0, 5.0, "b"))
    assert values(reads.latest_per_group(rows, "collection"), "collection", "value") == [("a", 1.0), ("a", 2.0), ("b", 5.0)]
    assert [r["value"] for r in reads.latest_top(rows, "collection", 2).collect()] == [5.0, 2.0]


def test_indicators(stored, spark):
    rows = reads.read_global(stored.filter("collection = ''"), "volume", "1 hour")
    assert [tuple(r) for r in reads.latest_value(rows).collect()] == [("volume__1_hour", T0 + 2 * H, 2.0)]
    page = reads.page_indicators(stored, ["volume", "count"], "1 day", collection="")
    assert values(page, "metric", "value") == [("count__1_day", 2.0), ("volume__1_day", 2.0)]


def test_series_keeps_the_newest_points_of_each_line(stored):
    lines = reads.series(reads.read_global(stored, "volume", "1 hour"), "collection", points=2)
    assert values(lines, "hue", "value") == [("", 1.0), ("", 2.0), ("b", 1.0), ("b", 2.0)]


def test_display_table(spark):
    rows = metric_rows(spark, ("m", datetime(2024, 1, 1), 1234567.4, "a"))
    table = reads.display_table(rows, "collection", "Name", "Volume", href_page="/c?x=")
    assert [tuple(r) for r in table.collect()] == [("<a target='_Self' href='/c?x=a'>a</a>", "1,234,567")]
    linked = reads.display_table(rows, "collection", href_col="metric")
    assert linked.columns == ["collection", "Value"]
    assert linked.first()["collection"] == "<a href='m'>a</a>"

import os
import re
import shutil
import time
from datetime import datetime, timedelta

import pytest

from helpers import message, values
from tallyhouse.operators.events import clean_events, clean_messages
from tallyhouse.plans import families as fam
from tallyhouse.schemas import COLLECTION_COLUMNS, GLOBAL_COLUMNS
from tallyhouse.sinks.archive import archive_writer, compact_index, read_index, write_archive
from tallyhouse.sinks.messages import console_writer
from tallyhouse.sinks.store import read_metrics
from tallyhouse.sources.archive import in_time_range, parse_time, read_archive, read_message_files
from tallyhouse.sources.topics import message_file_stream, topic_options, topic_stream
from tallyhouse.streaming import jobs

T0 = datetime(2024, 1, 1)


def arrive(folder, name, *texts):
    """One file of messages, newer than those before it."""
    folder.mkdir(exist_ok=True)
    path = folder / f"{name}.jsonl"
    path.write_text("\n".join(texts) + "\n")
    stamp = time.time() - 1000 + len(list(folder.iterdir()))
    os.utime(path, (stamp, stamp))


def at(minutes=0, seconds=0):
    return (T0 + timedelta(minutes=minutes, seconds=seconds)).isoformat()


def drain(spark, rows, tmp_path):
    writer = jobs.store_writer(rows, str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    jobs.run_available(writer, spark, state_partitions=2, timeout=300)
    return read_metrics(spark, str(tmp_path / "store"))


def make_history(folder, files=4, per_file=40):
    kinds = ["item_sold", "item_listed", "item_transferred", "item_received_bid", "phx_reply"]
    texts = []
    for i in range(files * per_file):
        texts.append(
            message(
                kinds[i % 5],
                at(minutes=i * 3),
                quantity=i % 4,
                usd=str(i % 7) if i % 3 else None,
                slug=f"c{i % 3}",
                nft=f"n{i % 5}",
            )
        )
    for f in range(files):
        arrive(folder, f"f{f}", *texts[f * per_file : (f + 1) * per_file])


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_streams_end_with_the_batch_result(spark, tmp_path, slide):
    make_history(tmp_path / "in")
    source = message_file_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    clean = clean_messages(source)
    batch = clean_messages(spark.read.text(str(tmp_path / "in")))
    stream = drain(spark, jobs.global_stream(clean, "1 hour", slide, "10 minutes"), tmp_path / "g")
    assert values(stream, *GLOBAL_COLUMNS) == values(fam.global_metrics(batch, "1 hour", slide), *GLOBAL_COLUMNS)
    rows = jobs.collections_stream(clean, "1 hour", slide, "10 minutes", with_asset_key=True)
    stream = drain(spark, rows, tmp_path / "c")
    expected = (
        fam.collection_sales(batch, "1 hour", slide)
        .unionByName(fam.collection_transactions(batch, "1 hour", slide))
        .unionByName(fam.asset_transfers(batch, "1 hour", slide))
    )
    assert values(stream, *COLLECTION_COLUMNS) == values(expected, *COLLECTION_COLUMNS)


def test_without_a_watermark_nothing_is_dropped(spark, tmp_path):
    arrive(tmp_path / "in", "a", message(sent_at=at(minutes=600)))
    arrive(tmp_path / "in", "b", message(sent_at=at(minutes=1)))
    clean = clean_messages(message_file_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
    stored = drain(spark, jobs.global_stream(clean, "1 hour"), tmp_path)
    assert stored.filter("metric = 'total_sales__1_hour'").count() == 2


def test_late_rows_are_dropped_after_a_restart_and_open_windows_go_on(spark, tmp_path):
    source = tmp_path / "in"

    def run():
        clean = clean_messages(message_file_stream(spark, str(source), files_per_trigger=1))
        stored = drain(spark, jobs.global_stream(clean, "1 minute", watermark="3 minutes"), tmp_path)
        return values(stored.filter("metric = 'total_sales__1_minute'"), "timestamp", "value")

    arrive(source, "1", message(sent_at=at(0, 10)), message(sent_at=at(10, 10)))
    assert run() == [(T0 + timedelta(minutes=1), 1.0), (T0 + timedelta(minutes=11), 1.0)]
    arrive(source, "2", *[message(sent_at=at(*t)) for t in ((0, 20), (7, 30), (6, 30), (10, 20))])
    assert run() == [
        (T0 + timedelta(minutes=1), 1.0),
        (T0 + timedelta(minutes=11), 2.0),
        (T0 + timedelta(minutes=8), 1.0),
    ]


def test_a_restart_neither_repeats_nor_skips(spark, tmp_path):
    source = tmp_path / "in"

    def run():
        clean = clean_messages(message_file_stream(spark, str(source)))
        stored = drain(spark, jobs.global_stream(clean, "1 hour", watermark="1 hour"), tmp_path)
        return values(stored.filter("metric = 'total_sales__1_hour'"), "value")

    arrive(source, "1", message(sent_at=at(5)))
    assert run() == [(1.0,)]
    assert run() == [(1.0,)]
    arrive(source, "2", message(sent_at=at(6)))
    assert run() == [(2.0,)]


def test_rankings_are_refused_on_streams(spark, tmp_path):
    from tallyhouse.operators.catalogue import TOP_ASSETS_BY_SALES
    from tallyhouse.operators.metrics import metric_stream

    arrive(tmp_path / "in", "a", message())
    clean = clean_messages(message_file_stream(spark, str(tmp_path / "in")))
    with pytest.raises(ValueError):
        metric_stream(clean, [TOP_ASSETS_BY_SALES], "1 hour")


def test_stream_state_is_one_aggregate_dropped_behind_the_watermark(spark, tmp_path):
    make_history(tmp_path / "in")
    clean = clean_messages(message_file_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
    rows = jobs.collections_stream(clean, "30 minutes", watermark="10 minutes")
    writer = jobs.store_writer(rows, str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    query = jobs.start(writer.trigger(availableNow=True), spark, 2)
    query.awaitTermination(300)
    operators = query.lastProgress["stateOperators"]
    assert len(operators) == 1
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress) > 0


def test_debug_output_keeps_update_mode(spark, tmp_path):
    arrive(tmp_path / "in", "a", message())
    clean = clean_messages(message_file_stream(spark, str(tmp_path / "in")))
    writer = console_writer(jobs.global_stream(clean, "1 hour"), str(tmp_path / "checkpoint"))
    jobs.run_available(writer, spark, 2, timeout=120)


def test_wait_for_all_reports_a_failed_query(spark, tmp_path):
    arrive(tmp_path / "in", "a", message())
    clean = clean_messages(message_file_stream(spark, str(tmp_path / "in")))
    rows = jobs.global_stream(clean, "1 hour")

    def fail(batch, batch_id):
        raise RuntimeError("no room")

    good = jobs.start(jobs.store_writer(rows, str(tmp_path / "s"), str(tmp_path / "c1")), spark, 2)
    bad = jobs.start(
        rows.writeStream.foreachBatch(fail).outputMode("update").option("checkpointLocation", str(tmp_path / "c2")),
        spark,
        2,
    )
    with pytest.raises(Exception):
        jobs.wait_for_all(spark, [good, bad])
    assert not good.isActive and not bad.isActive


def test_topic_streams_need_the_kafka_package(spark):
    with pytest.raises(Exception, match="kafka"):
        topic_stream(spark, "nowhere:1", "t", from_beginning=True)


# Archive


def stamped(spark, *rows):
    return spark.createDataFrame(list(rows), "value string, timestamp timestamp")


def test_archive_folders_are_arrival_hours_and_round_trip(spark, tmp_path):
    path = str(tmp_path / "archive")
    write_archive(stamped(spark, (message(), T0), (message(), T0 + timedelta(hours=5)), (None, T0)), path)
    assert (tmp_path / "archive" / "year=2024" / "month=01" / "day=01" / "hour=05").is_dir()
    raw = read_archive(spark, path)
    assert values(raw, "year", "month", "day", "hour") == [(2024, 1, 1, 0), (2024, 1, 1, 5)]
    assert raw.filter("payload.payload.item.nft_id = 'n1'").count() == 2


def days(n):
    return T0 + timedelta(days=n)


def days_read(raw):
    return sorted({int(re.search(r"day=(\d+)", f)[1]) for f in raw.inputFiles()})


def test_an_indexed_range_lists_only_folders_that_hold_it(spark, tmp_path):
    """Messages that arrive days late, and before they were sent, by a clock that is ahead."""
    path = str(tmp_path / "archive")
    on_time = [(message(sent_at=days(d).isoformat(), nft=f"on-{d}"), days(d)) for d in range(20)]
    late = [(message(sent_at=days(5).isoformat(), nft="late"), days(12)), (message(sent_at=days(6).isoformat(), nft="ahead"), days(2))]
    write_archive(stamped(spark, *on_time), path)
    write_archive(stamped(spark, *late, (message(sent_at=None), days(5)), ("no json", days(6))), path)
    raw = read_archive(spark, path, days(5), days(6))
    assert days_read(raw) == [3, 6, 7, 13]
    clean = in_time_range(clean_events(raw), days(5), days(6))
    assert values(clean, "item_nft_id") == [("ahead",), ("late",), ("on-5",), ("on-6",)]
    assert read_archive(spark, path, days(100)).collect() == []
    assert days_read(read_archive(spark, path, start=days(18))) == [19, 20]
    assert days_read(read_archive(spark, path, end=days(0))) == [1]
    index = read_index(spark, path)
    assert index.agg({"messages": "sum"}).first()[0] == 24
    before = sorted(map(tuple, index.collect()), key=repr)
    assert compact_index(spark, path)
    assert sorted(map(tuple, read_index(spark, path).collect()), key=repr) == before
    assert days_read(read_archive(spark, path, days(5), days(6))) == [3, 6, 7, 13]


def test_an_archive_without_an_index_is_cut_only_where_told(spark, tmp_path):
    path = str(tmp_path / "archive")
    write_archive(stamped(spark, *[(message(), days(d)) for d in range(10)]), path)
    shutil.rmtree(f"{path}/_index")
    for folder in list((tmp_path / "archive").rglob("batch=*")):  # as others write it
        for file in folder.iterdir():
            file.rename(folder.parent / file.name)
        folder.rmdir()
    day = days(5)
    assert sorted(r["day"] for r in read_archive(spark, path, day, day).collect()) == list(range(1, 11))
    raw = read_archive(spark, path, day, day, skew=timedelta(days=1), lateness=timedelta(days=1))
    assert sorted(r["day"] for r in raw.collect()) == [5, 6, 7]
    assert raw.columns == ["event", "payload", "topic", "year", "month", "day", "hour"]
    plan = raw._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "year" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "archive")
    first = stamped(spark, (message(nft="a"), T0), (message(nft="b"), T0 + timedelta(hours=1)))
    for _ in range(2):
        write_archive(first, path, batch="q-0")
        write_archive(stamped(spark, (message(nft="c"), T0)), path, batch="q-1")
    assert values(clean_events(read_archive(spark, path)), "item_nft_id") == [("a",), ("b",), ("c",)]
    assert values(read_index(spark, path), "batch", "messages") == [("q-0", 1), ("q-0", 1), ("q-1", 1)]


def test_files_of_an_hour_do_not_grow_with_the_tasks(spark, tmp_path):
    path = tmp_path / "archive"
    rows = stamped(spark, *[(message(nft=str(i)), T0 + timedelta(hours=i % 2)) for i in range(400)]).repartition(40)
    write_archive(rows, str(path))
    assert len(list(path.rglob("hour=*/batch=*/*.gz"))) <= 4
    write_archive(rows, str(tmp_path / "small"), max_records_per_file=50)
    assert len(list((tmp_path / "small").rglob("hour=*/batch=*/*.gz"))) == 8


def test_archive_stream_writes_each_message_once(spark, tmp_path):
    make_history(tmp_path / "in", files=3)
    for _ in range(2):
        messages = message_file_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
        writer = archive_writer(messages, str(tmp_path / "out"), str(tmp_path / "checkpoint"), every=2)
        jobs.run_available(writer, spark, 2, timeout=300)
    assert read_archive(spark, str(tmp_path / "out")).count() == 120
    index = read_index(spark, str(tmp_path / "out"))
    assert index.agg({"messages": "sum"}).first()[0] == 120
    assert index.select("batch").distinct().count() == 3


def test_limits_per_trigger(spark, tmp_path):
    make_history(tmp_path / "in", files=5, per_file=10)
    size = next((tmp_path / "in").iterdir()).stat().st_size
    source = message_file_stream(spark, str(tmp_path / "in"), bytes_per_trigger=2 * size + size // 2)
    sizes = []
    writer = source.writeStream.foreachBatch(lambda b, i: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "k"))
    jobs.run_available(writer, spark, 2, timeout=300)
    assert len(sizes) >= 2 and sum(sizes) == 50 and max(sizes) <= 30
    with pytest.raises(ValueError):
        message_file_stream(spark, str(tmp_path / "in"), 1, 100)
    assert topic_options(1000, 10, "1 minute") == {"maxOffsetsPerTrigger": "1000", "minOffsetsPerTrigger": "10", "maxTriggerDelay": "1 minute"}
    assert topic_options() == {}
    for wrong in ((None, None, "1 minute"), (5, 10, None)):
        with pytest.raises(ValueError):
            topic_options(*wrong)


def test_time_range_reads_include_both_ends(spark, tmp_path):
    arrive(tmp_path / "in", "a", *[message(sent_at=at(minutes=m)) for m in range(4)])
    clean = clean_messages(spark.read.text(str(tmp_path / "in")))
    assert read_message_files(spark, str(tmp_path / "in")).count() == 4
    kept = in_time_range(clean, T0 + timedelta(minutes=1), T0 + timedelta(minutes=2))
    assert kept.count() == 2


def test_parse_time():
    assert parse_time("2024-07-28") == datetime(2024, 7, 28)
    assert parse_time("2024-07-28T12:00:01") == datetime(2024, 7, 28, 12, 0, 1)
    with pytest.raises(ValueError):
        parse_time("28/07/2024")

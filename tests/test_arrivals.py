"""The given events as files of messages that streams and archives read."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyhouse.registry import queries
from tallyhouse.sources import tables
from tallyhouse.streaming import jobs

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def given(spark, path, times):
    rows = [(i, t, i % 20, "purchase", 2.5, f'{{"k": {i % 13}}}') for i, t in enumerate(times)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{path}/events.parquet")
    return str(path)


def batches(spark, path, tmp_path):
    seen = []

    def keep(batch, number):
        found = batch.agg(F.min("timestamp"), F.max("timestamp"), F.count("*")).first()
        seen.append((*found, batch.rdd.getNumPartitions()))

    stream = queries._message_stream(spark, path)
    jobs.run_available(stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "k")), spark, 2, timeout=300)
    return seen


def test_a_micro_batch_is_one_part_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "FILE_ROWS", (20, 1000))
    start = datetime(2024, 1, 1)
    path = given(spark, tmp_path / "in", [start + timedelta(minutes=i) for i in range(400)] + [None] * 5)
    seen = batches(spark, path, tmp_path)
    assert [n for _, _, n, _ in seen] == [100, 100, 100, 105]
    assert all(tasks > 1 for *_, tasks in seen)
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_parts_of_few_rows_have_as_many_files(spark, tmp_path, monkeypatch):
    """All events but one are in the first part; two parts are empty."""
    monkeypatch.setattr(queries, "FILE_ROWS", (10, 1000))
    start = datetime(2024, 1, 1)
    path = given(spark, tmp_path / "in", [start + timedelta(seconds=i) for i in range(90)] + [start + timedelta(days=9)])
    assert queries._count_files(spark, queries._arrivals(spark, path)) == queries.FILES * 3
    seen = batches(spark, path, tmp_path)
    assert [n for _, _, n, _ in seen] == [90, 0, 0, 1]
    expected = {tuple(r) for r in tables.market_messages(spark, path).collect()}
    assert {tuple(r) for r in queries._messages(spark, path).collect()} == expected


def test_files_grow_with_the_rows():
    assert [queries._files_per_part(n, 12) for n in (0, 1, 25_000, 25_001, 150_000, 9_000_000, 90_000_000)] == [1, 1, 1, 2, 6, 12, 90]

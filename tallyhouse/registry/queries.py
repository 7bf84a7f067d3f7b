"""Every operator as a named query over the given tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import TimestampType

from tallyhouse.functions.windows import ALL_TIME, BATCH_GRAINS, metric_name
from tallyhouse.operators import events as ev
from tallyhouse.operators import explore
from tallyhouse.operators.quantiles import quantiles
from tallyhouse.plans import families as fam
from tallyhouse.plans.rollup import asset_chain, partial_groups
from tallyhouse.schemas import COLLECTION_COLUMNS, COLLECTION_SCHEMA, GLOBAL_COLUMNS, GLOBAL_SCHEMA, SOLD
from tallyhouse.serving import reads
from tallyhouse.session import materialise, scratch_dir, use_utc
from tallyhouse.sinks.archive import archive_writer, write_archive
from tallyhouse.sinks.clean_table import read_days, write_days
from tallyhouse.sinks.messages import decode_messages, encode_messages
from tallyhouse.sinks.snapshots import SnapshotList, Storage
from tallyhouse.sinks.store import compact_metrics, read_metrics, write_metrics
from tallyhouse.sources import tables
from tallyhouse.sources.archive import in_time_range, read_archive, read_message_files
from tallyhouse.sources.topics import message_file_stream
from tallyhouse.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = datetime(2024, 2, 1)
RANGE = (datetime(2024, 1, 5), datetime(2024, 1, 20, 12, 30))
MIDWAY = datetime(2024, 1, 15, 12, 0)
WATERMARK = "3 minutes"
#: Parts that the given events arrive in where they are streamed; each is a micro-batch.
FILES = 4
#: Least and greatest numbers of rows that the files of a part are meant to have.
FILE_ROWS = (25_000, 1_000_000)
MESSAGE = "value string, timestamp timestamp"
PAGE = [
    "total_number_of_events",
    "total_transfers",
    "total_items_transferred",
    "total_sales",
    "total_usd_volume",
]


def _plain_times(rows: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the tables have them."""
    for field in rows.schema.fields:
        if isinstance(field.dataType, TimestampType):
            rows = rows.withColumn(field.name, F.col(field.name).cast("timestamp_ntz"))
    return rows


def _on_events(build: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return _plain_times(build(tables.market_events(spark, sf_dir)))

    return query


def _on_trades(build: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return _plain_times(build(tables.market_trades(spark, sf_dir)))

    return query


def _on_messages(build: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return _plain_times(build(tables.market_messages(spark, sf_dir)))

    return query


#: Folders that a session has filled once, by what they hold.
_FILLED: dict[tuple[str, str, str], str] = {}


def _filled(spark: SparkSession, sf_dir: str, name: str, fill: Callable[[str], object]) -> str:
    """A scratch folder that is filled at its first use in a session, as a stored table would be."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FILLED or not Storage(spark, _FILLED[key]).exists(""):
        path = scratch_dir(spark, name)
        fill(path)
        _FILLED[key] = path
    return _FILLED[key]


def _files_per_part(rows: int, cores: int) -> int:
    """Files of one micro-batch: enough to occupy the cores, none with over a million rows."""
    return max(1, min(cores, math.ceil(rows / FILE_ROWS[0])), math.ceil(rows / FILE_ROWS[1]))


def _arrivals(spark: SparkSession, sf_dir: str, parts: int = FILES) -> str:
    """The given events as messages in files that arrive part by part, in the order of their times.

    Messages are encoded once, by as many tasks as there are files. Every part
    has the same number of files, so that a micro-batch of that many is one part.
    """

    def fill(path: str) -> None:
        use_utc(spark)
        events = tables.table(spark, sf_dir, "events")
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        low, high, rows = events.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
        part = F.least(F.floor((at - F.lit(low)) * parts / F.lit(max((high or 0) - (low or 0), 1))), F.lit(parts - 1))
        placed = events.withColumn("part", F.coalesce(part, F.lit(parts - 1)))
        files = _files_per_part(math.ceil(rows / parts), spark.sparkContext.defaultParallelism)
        for i in range(parts):
            arrived = placed.filter(F.col("part") == i).select(events.columns).repartition(files)
            tables.events_to_messages(arrived).write.mode("append").parquet(path)
            # Tasks without rows write no file.
            for _ in range(_count_files(spark, path), files * (i + 1)):
                spark.createDataFrame([], MESSAGE).write.mode("append").parquet(path)

    return _filled(spark, sf_dir, "arrivals", fill)


def _count_files(spark: SparkSession, path: str) -> int:
    return sum(name.endswith(".parquet") for name in Storage(spark, path).names(""))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages that have arrived."""
    use_utc(spark)
    return spark.read.schema(MESSAGE).parquet(_arrivals(spark, sf_dir))


def _message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as they arrive, a part per micro-batch."""
    use_utc(spark)
    path = _arrivals(spark, sf_dir)
    each = _count_files(spark, path) // FILES
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", each).parquet(path)


def _drain(spark: SparkSession, writer: DataStreamWriter) -> None:
    jobs.run_available(writer, spark, state_partitions=spark.sparkContext.defaultParallelism)


def _to_files(spark: SparkSession, stream: DataFrame) -> DataFrame:
    path = scratch_dir(spark, "stream")
    _drain(
        spark,
        stream.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append"),
    )
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _to_store(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = scratch_dir(spark, "store")
    _drain(spark, jobs.store_writer(rows, f"{path}/rows", checkpoint=f"{path}/checkpoint"))
    return read_metrics(spark, f"{path}/rows")


# Scans and messages


def _envelope_fields(raw: DataFrame) -> DataFrame:
    payload = F.from_json("payload", "event_type string, sent_at string")
    return raw.select("event", "topic", payload["event_type"].alias("event_type"), payload["sent_at"].alias("sent_at"))


def scan_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    path = scratch_dir(spark, "archive")
    write_archive(_messages(spark, sf_dir), path)
    return _plain_times(ev.clean_events(read_archive(spark, path)))


def message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    path = scratch_dir(spark, "messages")
    tables.market_messages(spark, sf_dir).select("value").write.text(path)
    return _plain_times(ev.clean_events(read_message_files(spark, path)))


def archive_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a range, found by the archive's index: some arrive days late, some by clocks that are behind."""
    messages = _messages(spark, sf_dir)
    key = F.pmod(F.xxhash64("value"), F.lit(10))
    late = F.when(key == 0, F.expr("interval 5 days")).when(key == 1, F.expr("interval -2 days")).otherwise(F.expr("interval 40 seconds"))
    path = scratch_dir(spark, "archive")
    arrived = messages.withColumn("timestamp", F.col("timestamp") + late)
    for i, half in enumerate((F.col("timestamp") < F.lit(MIDWAY), ~(F.col("timestamp") < F.lit(MIDWAY)) | F.col("timestamp").isNull())):
        write_archive(arrived.filter(half), path, batch=str(i))
    return _plain_times(in_time_range(ev.clean_events(read_archive(spark, path, *RANGE)), *RANGE))


def archive_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "archive")
    messages = _message_stream(spark, sf_dir)
    _drain(spark, archive_writer(messages, f"{path}/rows", f"{path}/checkpoint"))
    archived = read_archive(spark, f"{path}/rows")
    return archived.groupBy("year", "month", "day", "hour").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("event") == "item_transferred").alias("transfers"),
    )


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ev.split_envelope(_message_stream(spark, sf_dir))
    return _plain_times(_to_files(spark, ev.clean_events(raw, is_json_payload=True)))


def stream_raw_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ev.split_envelope(_message_stream(spark, sf_dir))
    return _envelope_fields(_to_files(spark, raw))


def _round_trip(clean: DataFrame) -> DataFrame:
    return decode_messages(encode_messages(fam.global_metrics(clean, "1 day")), GLOBAL_SCHEMA)


def _keyed_round_trip(clean: DataFrame) -> DataFrame:
    rows = fam.collection_sales(clean, "1 day")
    parsed = F.from_json("value", COLLECTION_SCHEMA)
    encoded = encode_messages(rows, key_column="collection")
    return encoded.select("key", parsed.alias("row")).select("key", "row.metric", "row.timestamp", "row.value")


# Metric table


def upsert_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run over part of the time, then a full one over it."""
    use_utc(spark)
    clean = tables.market_events(spark, sf_dir)
    path = scratch_dir(spark, "store")
    write_metrics(fam.global_feed(in_time_range(clean, end=MIDWAY), "1 day"), path, run=1)
    write_metrics(fam.global_feed(clean, "1 day"), path, run=2)
    return _plain_times(read_metrics(spark, path).select(*GLOBAL_COLUMNS))


def upsert_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    clean = tables.market_events(spark, sf_dir)
    path = scratch_dir(spark, "store")
    early = in_time_range(clean, end=MIDWAY)
    write_metrics(fam.collection_sales(early, "1 day", with_asset_key=True), path, run=1)
    write_metrics(fam.collections_feed(clean, "1 day", with_asset_key=True), path, run=2)
    return _plain_times(read_metrics(spark, path).select(*COLLECTION_COLUMNS))


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream fills the table; it is compacted before the stream's last batches, while it runs, and after."""
    rows = jobs.global_stream(ev.clean_messages(_message_stream(spark, sf_dir)), "1 hour", watermark=WATERMARK)
    path = scratch_dir(spark, "store")
    table, checkpoint = f"{path}/rows", f"{path}/checkpoint"
    writer = jobs.store_writer(rows, table, checkpoint).trigger(availableNow=True)
    query = jobs.start(writer, spark, state_partitions=spark.sparkContext.defaultParallelism)
    seen = 0
    while not query.awaitTermination(1):
        written = len(SnapshotList(spark, table).state().writes)
        if written > seen:
            compact_metrics(spark, table)
            seen = 0
    compact_metrics(spark, table, everything=True)
    return _plain_times(read_metrics(spark, table).select(*GLOBAL_COLUMNS))


def messages_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric messages of a topic to the keyed table, assets with their keys; what is no message is rejected."""
    use_utc(spark)
    feed = fam.collections_feed(tables.market_events(spark, sf_dir), "1 day", with_asset_key=True)
    path = scratch_dir(spark, "messages")
    texts = encode_messages(feed)
    torn = texts.filter(F.pmod(F.xxhash64("value"), F.lit(100)) == 0).select(F.expr("left(value, 20)").alias("value"))
    texts.union(torn).repartition(FILES).write.text(f"{path}/topic")
    stream = message_file_stream(spark, f"{path}/topic", files_per_trigger=1)
    _drain(spark, jobs.messages_to_store(stream, f"{path}/rows", f"{path}/checkpoint"))
    return _plain_times(read_metrics(spark, f"{path}/rows").select(*COLLECTION_COLUMNS))


# Feeds over several grains


def global_feed_every_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batch grains merged from one pass over the events."""
    use_utc(spark)
    clean = tables.market_events(spark, sf_dir)
    parts = materialise(partial_groups(clean), scratch_dir(spark, "partials"))
    feeds = [fam.global_feed(clean, grain, as_of=AS_OF, partials=parts) for grain in BATCH_GRAINS]
    return reduce(DataFrame.unionByName, [_plain_times(feed) for feed in feeds])


def collections_feed_every_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    clean = tables.market_events(spark, sf_dir)
    path = scratch_dir(spark, "partials")
    parts = materialise(partial_groups(clean), f"{path}/collections")
    assets = asset_chain(clean, BATCH_GRAINS, f"{path}/assets")
    feeds = [
        fam.collections_feed(clean, grain, as_of=AS_OF, partials=parts, asset_partials=assets.get(grain))
        for grain in BATCH_GRAINS
    ]
    return reduce(DataFrame.unionByName, [_plain_times(feed) for feed in feeds])


def _sold_only(feed: Callable[..., DataFrame], both_ways: bool) -> Query:
    """A feed where listings are no sales; from partial groups that hold all event types, or from events."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        clean = tables.market_events(spark, sf_dir)
        parts = materialise(partial_groups(clean), scratch_dir(spark, "partials")) if both_ways else None
        return _plain_times(feed(clean, "1 day", sale_types=SOLD, partials=parts))

    return query


def landed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed over a range of a kept table: landed once, then a part of its days again."""
    use_utc(spark)
    path = scratch_dir(spark, "landed")
    clean = tables.market_events(spark, sf_dir)
    write_days(clean, path)
    again = (datetime(2024, 1, 8), datetime(2024, 1, 12))
    write_days(in_time_range(clean, *again), path, *again)
    return _plain_times(fam.global_feed(read_days(spark, path, *RANGE), "1 day"))


# Streams


def stream_global_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = ev.clean_messages(_message_stream(spark, sf_dir))
    stored = _to_store(spark, jobs.global_stream(clean, "1 hour", watermark=WATERMARK))
    return _plain_times(stored.select(*GLOBAL_COLUMNS))


def stream_collections_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = ev.clean_messages(_message_stream(spark, sf_dir))
    rows = jobs.collections_stream(clean, "1 hour", watermark=WATERMARK, with_asset_key=True)
    return _plain_times(_to_store(spark, rows).select(*COLLECTION_COLUMNS))


def stream_global_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = ev.clean_messages(_message_stream(spark, sf_dir))
    stored = _to_store(spark, jobs.global_stream(clean, "5 minutes", watermark=WATERMARK))
    return _plain_times(stored.select(*GLOBAL_COLUMNS))


def stream_no_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is dropped, however late: groups of all batches stay open."""
    clean = ev.clean_messages(_message_stream(spark, sf_dir))
    stored = _to_store(spark, jobs.global_stream(clean, "1 day"))
    return _plain_times(stored.select(*GLOBAL_COLUMNS))


def stream_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream fills the table; the last value per key is ranked on read."""
    clean = ev.clean_messages(_message_stream(spark, sf_dir))
    rows = jobs.collections_stream(clean, "1 day", watermark=WATERMARK, with_asset_key=True)
    stored = _to_store(spark, rows)
    volumes = stored.filter(F.col("metric") == metric_name("collection_total_usd_volume", "1 day"))
    top = reads.latest_top(volumes, "collection", n=10)
    return _plain_times(top.select("metric", "timestamp", "collection", "value"))


def stream_sliding_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = ev.clean_messages(_message_stream(spark, sf_dir))
    counts = jobs.collection_counts(clean, "1 minute", "30 seconds", "30 seconds")
    path = scratch_dir(spark, "stream")

    def keep_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    writer = (
        counts.writeStream.foreachBatch(keep_batch)
        .outputMode("update")
        .option("checkpointLocation", f"{path}/checkpoint")
    )
    _drain(spark, writer)
    changes = spark.read.parquet(f"{path}/rows")
    keys = ["window_start", "window_end", "collection_slug"]
    return _plain_times(changes.groupBy(*keys).agg(F.max_by("count", "batch").alias("count")))


def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table arrives, the query stops, and the whole table arrives
    again: after the restart only windows still open count the second copy."""
    use_utc(spark)
    path = scratch_dir(spark, "late")
    messages = tables.market_messages(spark, sf_dir).select("value")

    def arrive_and_run() -> None:
        messages.write.mode("append").text(f"{path}/messages")
        source = spark.readStream.schema("value string").text(f"{path}/messages")
        rows = jobs.global_stream(ev.clean_messages(source), "1 hour", watermark=WATERMARK)
        _drain(spark, jobs.store_writer(rows, f"{path}/rows", checkpoint=f"{path}/checkpoint"))

    arrive_and_run()
    arrive_and_run()
    return _plain_times(read_metrics(spark, f"{path}/rows").select(*GLOBAL_COLUMNS))


# Reads: all of the metric table, which a batch run has filled


FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "global_1h": lambda c: fam.global_feed(c, "1 hour"),
    "global_all_time": lambda c: fam.global_feed(c, ALL_TIME, as_of=AS_OF),
    "collections_1d": lambda c: fam.collections_feed(c, "1 day", with_asset_key=True),
    "top_20_all_time": lambda c: fam.top_collections_all_time(c, n=20, as_of=AS_OF),
}


def _served(feed: str, columns: list[str], read: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)

        def fill(path: str) -> None:
            write_metrics(FEEDS[feed](tables.market_events(spark, sf_dir)), path, run=feed)
            compact_metrics(spark, path)

        path = _filled(spark, sf_dir, f"store-{feed}", fill)
        return _plain_times(read(read_metrics(spark, path).select(*columns)))

    return query


def _metric(rows: DataFrame, name: str, grain: str) -> DataFrame:
    return rows.filter(F.col("metric") == metric_name(name, grain))


def _transfer_ranks(rows: DataFrame) -> DataFrame:
    return reads.read_global(rows, "top_collections_by_transfers_volume_transfers_count", "1 hour")


def _asset_volumes(rows: DataFrame) -> DataFrame:
    return reads.read_collection(rows, "coll-3", "collection_top_assets_by_sales_volume", "1 day")


def _display(rows: DataFrame) -> DataFrame:
    top = _metric(rows, "top_collections_by_sales_volume_usd_price", ALL_TIME)
    return reads.display_table(
        reads.latest_top(top, "collection", n=20),
        "collection",
        value_alias="volume",
        href_page="/collections?collection=",
    )


def _quartiles(clean: DataFrame) -> DataFrame:
    rows = _metric(fam.global_metrics(clean, "1 hour"), "total_transfers", "1 hour")
    stored = materialise(rows.select("value"), scratch_dir(clean.sparkSession, "values"))
    return explore.metric_quartiles(stored)


def price_quantiles(clean: DataFrame) -> DataFrame:
    """Exact quantiles of all prices; decimals beyond the sixth are the proportion's rounding."""
    spark = clean.sparkSession
    stored = materialise(clean.select("usd_price"), scratch_dir(spark, "values"))
    shares = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    found = zip(shares, quantiles(stored, "usd_price", shares), strict=True)
    return spark.createDataFrame(list(found), "share double, usd_price double").withColumn("usd_price", F.round("usd_price", 6))


def _summary(clean: DataFrame) -> DataFrame:
    rows = _metric(fam.global_metrics(clean, "1 hour"), "total_transfers", "1 hour")
    return explore.metric_summary(rows).drop("quartiles").withColumn("std", F.round("std", 6))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        # scans
        "scan_archive": scan_archive,
        "archive_time_range": archive_time_range,
        "message_files": message_files,
        "stream_scan": stream_scan,
        "envelope_json": _on_messages(lambda m: _envelope_fields(ev.split_envelope(m))),
        "parse_by_path": _on_messages(ev.parse_by_path),
        "time_range": _on_events(lambda c: in_time_range(c, *RANGE)),
        # sinks
        "encode_messages": _on_events(_round_trip),
        "encode_keyed": _on_events(_keyed_round_trip),
        "stream_raw_append": stream_raw_append,
        "archive_hourly": archive_hourly,
        "upsert_global": upsert_global,
        "upsert_collections": upsert_collections,
        "store_compacted": store_compacted,
        "messages_to_store": messages_to_store,
        # clean events
        "clean_events": _on_messages(lambda m: ev.clean_events(ev.parse_messages(m))),
        "clean_events_json": _on_messages(lambda m: ev.clean_events(ev.split_envelope(m), is_json_payload=True)),
        "transferred_items": _on_events(ev.transferred_items),
        "sales_items": _on_events(ev.sales_items),
        # collection, asset and global metrics
        "global_all_time": _on_events(lambda c: fam.global_all_time(c, as_of=AS_OF)),
        "collection_all_time": _on_events(lambda c: fam.collection_all_time(c, as_of=AS_OF)),
        "top_collections_all_time": _on_events(lambda c: fam.top_collections_all_time(c, as_of=AS_OF)),
        "top_assets_all_time": _on_events(lambda c: fam.top_assets_all_time(c, as_of=AS_OF)),
        "global_sliding_1h_30m": _on_events(lambda c: fam.global_metrics(c, "1 hour", "30 minutes")),
        "asset_transfers_1h": _on_events(lambda c: fam.asset_transfers(c, "1 hour")),
        "top_assets_by_sales_1d": _on_events(lambda c: fam.top_assets_by_sales(c, "1 day")),
        "top_assets_by_transfers_1d": _on_events(lambda c: fam.top_assets_by_transfers(c, "1 day")),
        # feeds
        "global_feed_1h": _on_events(lambda c: fam.global_feed(c, "1 hour")),
        "collections_feed_1h": _on_events(lambda c: fam.collections_feed(c, "1 hour")),
        "global_feed_all_time": _on_events(lambda c: fam.global_feed(c, ALL_TIME, as_of=AS_OF)),
        "collections_feed_all_time": _on_events(lambda c: fam.collections_feed(c, ALL_TIME, as_of=AS_OF)),
        "global_feed_every_grain": global_feed_every_grain,
        "collections_feed_every_grain": collections_feed_every_grain,
        "global_feed_sold_only": _sold_only(fam.global_feed, both_ways=False),
        "global_feed_sold_only_partials": _sold_only(fam.global_feed, both_ways=True),
        "collections_feed_sold_only": _sold_only(fam.collections_feed, both_ways=False),
        "collections_feed_sold_only_partials": _sold_only(fam.collections_feed, both_ways=True),
        "landed_feed": landed_feed,
        "exploration_metrics": _on_events(lambda c: fam.exploration_metrics(c, "1 hour")),
        "collection_profile": _on_events(lambda c: fam.collection_profile(c, "1 hour")),
        "trades_global_feed_7d": _on_trades(lambda c: fam.global_feed(c, "7 days")),
        "trades_collections_feed_all_time": _on_trades(lambda c: fam.collections_feed(c, ALL_TIME, as_of=AS_OF)),
        # profiles and drill-downs
        "event_type_counts": _on_events(explore.event_type_counts),
        "event_type_counts_priced": _on_events(lambda c: explore.event_type_counts(c, priced_only=True)),
        "time_extent": _on_events(explore.time_extent),
        "range_profile": _on_events(lambda c: explore.range_profile(c, *RANGE)),
        "window_profile": _on_events(
            lambda c: explore.window_profile(c, "1 hour").withColumn(
                "total_assets_transferred", F.col("total_assets_transferred").cast("double")
            )
        ),
        "window_transactions": _on_events(lambda c: explore.window_transactions(c, "1 hour")),
        "window_sales": _on_events(lambda c: explore.window_sales(c, "1 hour")),
        "sales_of_top_collections": _on_events(lambda c: explore.sales_of_top_collections(c, "1 hour")),
        "sales_of_top_3_collections": _on_events(lambda c: explore.sales_of_top_collections(c, "14 days", top_n=3)),
        "sales_in_top_windows": _on_events(lambda c: explore.sales_in_top_windows(c, "1 hour")),
        "sales_in_top_10_windows": _on_events(lambda c: explore.sales_in_top_windows(c, "1 day", top_n=10)),
        "top_sales_by_price": _on_events(lambda c: explore.top_sales_by_price(c, "14 days")),
        "top_collection_stats": _on_events(lambda c: explore.top_collection_stats(c, "1 hour")),
        "metric_value_counts_all": _on_events(lambda c: explore.metric_value_counts(fam.global_metrics(c, "1 hour"))),
        "metric_value_counts": _on_events(lambda c: explore.metric_value_counts(fam.global_metrics(c, "1 hour"), 2000)),
        "metric_name_counts": _on_events(lambda c: explore.metric_name_counts(fam.global_feed(c, "1 hour"))),
        "metric_summary": _on_events(_summary),
        "metric_quartiles": _on_events(_quartiles),
        "price_quantiles": _on_events(price_quantiles),
        # streams
        "stream_global_1h": stream_global_1h,
        "stream_global_5m": stream_global_5m,
        "stream_no_watermark": stream_no_watermark,
        "stream_collections_1h": stream_collections_1h,
        "stream_late_drop": stream_late_drop,
        "stream_sliding_collection": stream_sliding_collection,
        "stream_to_store": stream_to_store,
        # reads
        "serve_global": _served(
            "global_1h", GLOBAL_COLUMNS, lambda r: reads.read_global(r, "total_transfers", "1 hour", *RANGE)
        ),
        "serve_global_limit": _served("global_1h", GLOBAL_COLUMNS, lambda r: reads.read_global(r, limit=100)),
        "serve_collection": _served(
            "collections_1d",
            COLLECTION_COLUMNS,
            lambda r: reads.read_collection(
                r, "coll-3", "collection_total_usd_volume", "1 day", *RANGE, order_ascending=True
            ),
        ),
        "indicator_latest": _served(
            "global_1h",
            GLOBAL_COLUMNS,
            lambda r: reads.latest_value(reads.read_global(r, "total_usd_volume", "1 hour")),
        ),
        "latest_per_group": _served(
            "global_1h", GLOBAL_COLUMNS, lambda r: reads.latest_per_group(_transfer_ranks(r), "collection")
        ),
        "latest_top_table": _served(
            "global_1h", GLOBAL_COLUMNS, lambda r: reads.latest_top(_transfer_ranks(r), "collection", n=10)
        ),
        "series_by_hue": _served(
            "collections_1d", COLLECTION_COLUMNS, lambda r: reads.series(_asset_volumes(r), "asset_name", points=5)
        ),
        "page_indicators": _served(
            "global_all_time", GLOBAL_COLUMNS, lambda r: reads.page_indicators(r, PAGE, ALL_TIME)
        ),
        "display_table": _served("top_20_all_time", GLOBAL_COLUMNS, _display),
    }
    for label, grain in {"1h": "1 hour", "12h": "12 hours", "1d": "1 day", "7d": "7 days", "14d": "14 days"}.items():
        q[f"global_windowed_{label}"] = _on_events(lambda c, g=grain: fam.global_metrics(c, g))
    for label, grain in {"1h": "1 hour", "1d": "1 day"}.items():
        q[f"collection_sales_{label}"] = _on_events(lambda c, g=grain: fam.collection_sales(c, g))
        q[f"collection_transactions_{label}"] = _on_events(lambda c, g=grain: fam.collection_transactions(c, g))
        q[f"top_collections_sales_{label}"] = _on_events(lambda c, g=grain: fam.top_collections_by_sales(c, g))
        q[f"top_collections_transfers_{label}"] = _on_events(
            lambda c, g=grain: fam.top_collections_by_transfers(c, g)
        )
    return q

import json
import os
from datetime import datetime, timedelta

import pytest

from helpers import T0, event, events, message, values
from tallyhouse import cli
from tallyhouse import manage as commands
from tallyhouse.plans import families as fam
from tallyhouse.plans.jobs import land, run_batch
from tallyhouse.plans.rollup import asset_chain, common_base, partial_groups
from tallyhouse.schemas import CLEAN_COLUMNS, COLLECTION_COLUMNS, GLOBAL_COLUMNS
from tallyhouse.session import scratch_dir
from tallyhouse.sinks.archive import write_archive
from tallyhouse.sinks.clean_table import read_clean, read_days, write_clean, write_days
from tallyhouse.sinks.messages import encode_messages
from tallyhouse.sinks.store import read_metrics

KINDS = ["item_sold", "item_listed", "item_transferred", "item_received_bid"]


@pytest.fixture
def archive(spark, tmp_path):
    rows = [
        (
            message(
                KINDS[i % 4],
                (T0 + timedelta(minutes=11 * i)).isoformat(),
                i % 3,
                str(i),
                slug=f"c{i % 3}",
                nft=f"n{i % 4}",
            ),
            T0 + timedelta(minutes=11 * i + 1),
        )
        for i in range(200)
    ]
    path = str(tmp_path / "archive")
    write_archive(spark.createDataFrame(rows, "value string, timestamp timestamp"), path)
    return path


def run(argv):
    args = cli.parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return (cli.batch if cli.mode_of(args) == "batch" else cli.stream)(args, spark)


@pytest.mark.parametrize("grain", ["1 hour", "all time"])
def test_batch_run_fills_both_tables(spark, tmp_path, archive, grain):
    g, c = str(tmp_path / "g"), str(tmp_path / "c")
    counts = run(["all", grain, "--raw-events-s3-uri", archive, "--global-store", g, "--collections-store", c])
    clean = cli.read_clean_archive(spark, archive)
    columns = ["metric", "collection", "value"]
    expected = fam.global_feed(clean, grain)
    assert counts[f"global {grain}"] == expected.count()
    assert values(read_metrics(spark, g), *columns) == values(expected, *columns)
    expected = fam.collections_feed(clean, grain)
    assert counts[f"collections {grain}"] == expected.count()
    columns = [x for x in COLLECTION_COLUMNS if x != "timestamp"]
    assert values(read_metrics(spark, c), *columns) == values(expected, *columns)


def test_many_grains_share_one_pass(spark, tmp_path, archive):
    g, c = str(tmp_path / "g"), str(tmp_path / "c")
    grains = ["1 hour", "12 hours", "1 day", "7 days", "14 days", "all time"]
    counts = run(
        ["all", grains[0], "--also", *grains[1:], "--raw-events-s3-uri", archive]
        + ["--global-store", g, "--collections-store", c]
    )
    assert len(counts) == 12
    clean = cli.read_clean_archive(spark, archive)
    for path, feed in ((g, fam.global_feed), (c, fam.collections_feed)):
        stored = read_metrics(spark, path)
        columns = [x for x in feed(clean, "1 hour").columns if x != "timestamp"]
        for grain in grains:
            expected = feed(clean, grain)
            got = stored.filter(stored.metric.endswith("__" + "_".join(grain.split())))
            assert values(got, *columns) == values(expected, *columns), (path, grain)


def test_partial_groups_keep_untimed_events_and_slides(spark):
    clean = events(
        spark,
        event(at=None, usd=2.0),
        event(slug=None, usd=None),
        event("item_received_bid", slug=None),
        event("item_transferred", at=T0 + timedelta(minutes=61), quantity=4),
        event("item_listed", "b", at=T0 + timedelta(minutes=119), usd=4.0),
    )
    parts = partial_groups(clean)
    for grain, slide in (("all time", None), ("1 day", None), ("12 hours", "6 hours")):
        as_of = datetime(2024, 2, 1)
        for feed in (fam.global_feed, fam.collections_feed):
            expected = feed(clean, grain, slide, as_of=as_of)
            merged = feed(clean, grain, slide, as_of=as_of, partials=parts)
            assert values(merged, *expected.columns) == values(expected, *expected.columns)


@pytest.mark.parametrize(
    "grains, slide, base",
    [
        (["14 days", "7 days", "all time"], None, 7 * 86400),
        (["1 day", "1 hour"], None, 3600),
        (["1 day", "12 hours"], "30 minutes", 1800),
        (["all time"], None, 86400),
    ],
)
def test_the_base_window_divides_all_grains(grains, slide, base):
    assert common_base(grains, slide) == f"{base} seconds"


@pytest.mark.parametrize("base", ["3600 seconds", "7200 seconds"])
def test_any_base_that_divides_the_grain_gives_the_same(spark, archive, base):
    clean = cli.read_clean_archive(spark, archive)
    parts = partial_groups(clean, base)
    for feed in (fam.global_feed, fam.collections_feed):
        expected = feed(clean, "12 hours", "4 hours")
        merged = feed(clean, "12 hours", "4 hours", partials=parts)
        assert values(merged, *expected.columns) == values(expected, *expected.columns)


def test_output_is_computed_once(spark, archive):
    """The row count of a write comes from the write itself."""
    writes = []

    def write(feed):
        writes.append(feed)
        feed.write.format("noop").mode("overwrite").save()

    clean = cli.read_clean_archive(spark, archive)
    counts = run_batch(clean, ["1 day"], write_global=write)
    assert len(writes) == 1
    assert counts == {"global 1 day": fam.global_feed(clean, "1 day").count()}


def test_batch_run_over_a_time_range_with_a_slide(spark, tmp_path, archive):
    g = str(tmp_path / "g")
    start, end = "2024-01-01T03:00:00", "2024-01-01T09:00:00"
    run(
        ["global", "1 hour", "--raw-events-s3-uri", archive, "--global-store", g, "--slide-duration", "30 minutes"]
        + ["--timestamp-start", start, "--timestamp-end", end]
    )
    clean = cli.read_clean_archive(spark, archive).filter(f"sent_at between '{start}' and '{end}'")
    expected = fam.global_feed(clean, "1 hour", "30 minutes")
    assert values(read_metrics(spark, g), *GLOBAL_COLUMNS) == values(expected, *GLOBAL_COLUMNS)


def test_batch_run_without_a_sink_counts_rows(archive, spark):
    assert run(["global", "1 day", "--raw-events-s3-uri", archive])["global 1 day"] > 0


def test_stream_run_then_batch_run_share_a_table(spark, tmp_path, archive):
    """Stream results stand until a batch recompute of the same keys replaces them."""
    source = tmp_path / "in"
    source.mkdir()
    texts = [r["value"] for r in spark.read.text(archive).select("value").collect()]
    (source / "a.jsonl").write_text("\n".join(texts))
    g, c, k = (str(tmp_path / x) for x in ("g", "c", "k"))
    options = ["--raw-events-files", str(source), "--checkpoint-dir", k, "--available-now", "--state-partitions", "2"]
    run(["all", "1 hour", "--mode", "stream", "--watermark-duration", "3 minutes", "--global-store", g]
        + ["--collections-store", c, *options])
    clean = cli.read_clean_archive(spark, archive)
    expected = fam.global_metrics(clean, "1 hour")
    assert values(read_metrics(spark, g), *GLOBAL_COLUMNS) == values(expected, *GLOBAL_COLUMNS)
    run(["global", "1 hour", "--raw-events-s3-uri", archive, "--global-store", g])
    expected = fam.global_feed(clean, "1 hour")
    assert values(read_metrics(spark, g), *GLOBAL_COLUMNS) == values(expected, *GLOBAL_COLUMNS)


@pytest.mark.parametrize(
    "argv",
    [
        ["global", "1 hour"],
        ["global", "1 minute"],
        ["global", "1 minute", "--checkpoint-dir", "/tmp/x"],
        ["global", "1 hour", "--raw-events-s3-uri", "/tmp/x", "--kafka-topic", "t"],
        ["global", "all time", "--mode", "stream"],
    ],
)
def test_missing_or_conflicting_options_are_refused(spark, argv):
    with pytest.raises(ValueError):
        run(argv)


@pytest.mark.parametrize("argv", [["global", "2 hours"], ["assets", "1 hour"]])
def test_unknown_choices_are_refused(argv):
    with pytest.raises(SystemExit):
        cli.parser().parse_args(argv)


def test_the_grain_picks_the_mode_unless_told():
    def mode(*argv):
        return cli.mode_of(cli.parser().parse_args(["all", *argv]))

    assert mode("1 HOUR") == mode("all time") == "batch"
    assert mode("30 seconds") == "stream"
    assert mode("30 seconds", "--mode", "batch") == "batch"


def test_landed_events_are_the_same_and_push_types_down(spark, tmp_path):
    kinds = [*KINDS, "", None, "01", "1"]
    clean = events(spark, *[event(k, usd=1.0, at=T0 + timedelta(days=i)) for i, k in enumerate(kinds)], event(at=None))
    write_clean(clean, str(tmp_path / "clean"))
    for table in (land(clean, str(tmp_path / "landed")), read_clean(spark, str(tmp_path / "clean"))):
        assert values(table, *CLEAN_COLUMNS) == values(clean, *CLEAN_COLUMNS)
        plan = table.filter("event_type = 'item_sold'")._jdf.queryExecution().toString()
        scan = next(line for line in plan.splitlines() if "PushedFilters" in line)
        assert "EqualTo(event_type,item_sold)" in scan.split("PushedFilters:")[1]


def test_a_run_over_nothing_writes_nothing(spark):
    count = lambda feed: feed.write.format("noop").mode("overwrite").save()
    counts = run_batch(events(spark).limit(0), ["1 hour", "1 day"], write_global=count, write_collections=count)
    assert set(counts.values()) == {0}


def test_scratch_needs_a_shared_folder(spark):
    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Bare(), "x")


@pytest.mark.parametrize("grain", ["1 hour", "all time"])
@pytest.mark.parametrize("types", [("item_sold",), ("item_listed", "item_received_bid"), ("none",)])
def test_partials_serve_any_sale_types(spark, archive, grain, types):
    clean = cli.read_clean_archive(spark, archive)
    parts, options = partial_groups(clean), {"sale_types": types, "as_of": datetime(2024, 2, 1)}
    for feed in (fam.global_feed, fam.collections_feed):
        expected = feed(clean, grain, **options)
        merged = feed(clean, grain, partials=parts, **options)
        assert values(merged, *expected.columns) == values(expected, *expected.columns)


def test_assets_come_from_a_chain_of_windows(spark, tmp_path):
    kinds = ["item_sold", "item_transferred", "item_listed"]
    rows = [event(kinds[i % 3], f"c{i % 2}", T0 + timedelta(hours=7 * i), f"n{i % 3}", usd=float(i % 5)) for i in range(600)]
    rows += [event(at=None, usd=3.0), event("item_transferred", slug=None, nft=None)]
    clean = events(spark, *rows)
    grains = ["1 hour", "1 day", "7 days", "14 days", "all time"]
    chain = asset_chain(clean, grains, str(tmp_path / "chain"))
    assert "1 hour" not in chain and {"14 days", "all time"} <= set(chain)
    assert chain["all time"].count() < chain["14 days"].count() < len(rows) / 2
    options = {"as_of": datetime(2024, 2, 1), "with_asset_key": True}
    for grain in grains:
        expected = fam.collections_feed(clean, grain, **options)
        merged = fam.collections_feed(clean, grain, asset_partials=chain.get(grain), **options)
        assert values(merged, *expected.columns) == values(expected, *expected.columns), grain
    apart = [event(nft=f"n{i}", at=T0 + timedelta(days=i)) for i in range(50)]
    assert asset_chain(events(spark, *apart), grains, str(tmp_path / "none")) == {}
    slid = asset_chain(clean, ["14 days"], str(tmp_path / "slid"), slide="7 days")
    expected = fam.collections_feed(clean, "14 days", "7 days", **options)
    merged = fam.collections_feed(clean, "14 days", "7 days", asset_partials=slid["14 days"], **options)
    assert values(merged, *expected.columns) == values(expected, *expected.columns)


def test_assets_need_groups_that_have_them(spark):
    with pytest.raises(ValueError, match="assets"):
        clean = events(spark, event())
        fam.collections_feed(clean, "1 day", asset_partials=partial_groups(clean))


def test_days_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "kept")
    first = events(spark, *[event(k, at=T0 + timedelta(days=i % 6, hours=i)) for i, k in enumerate(KINDS * 6)], event(at=None))
    for _ in range(2):
        write_days(first, path)
    assert values(read_days(spark, path), *CLEAN_COLUMNS) == values(first, *CLEAN_COLUMNS)
    low, high = T0 + timedelta(days=1), T0 + timedelta(days=4)
    again = events(spark, event("item_sold", slug="new", at=low), event("item_sold", slug="new", at=low + timedelta(days=2)), event(slug="out", at=high))
    write_days(again, path, low, high)
    kept = read_days(spark, path)
    assert kept.filter("collection_slug = 'out'").count() == 0
    inside = kept.filter(f"sent_at >= '{low}' and sent_at < '{high}'")
    assert values(inside, "collection_slug", "sent_at") == [("new", low), ("new", low + timedelta(days=2))]
    outside = f"sent_at is null or sent_at < '{low}' or sent_at >= '{high}'"
    assert values(kept.filter(outside), *CLEAN_COLUMNS) == values(first.filter(outside), *CLEAN_COLUMNS)
    one = read_days(spark, path, T0, T0 + timedelta(hours=30))
    plan = one._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "event_date" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    with pytest.raises(ValueError, match="days"):
        write_days(first, path, T0 + timedelta(hours=1), high)


def test_landed_events_feed_a_run(spark, tmp_path, archive):
    kept, g = str(tmp_path / "kept"), str(tmp_path / "g")
    manage(["land", "--raw-events-s3-uri", archive, "--path", kept])
    run(["global", "1 hour", "--clean-events", kept, "--sale-types", "item_sold", "--global-store", g])
    expected = fam.global_feed(cli.read_clean_archive(spark, archive), "1 hour", sale_types=("item_sold",))
    assert values(read_metrics(spark, g), *GLOBAL_COLUMNS) == values(expected, *GLOBAL_COLUMNS)


def manage(argv):
    from pyspark.sql import SparkSession

    args = commands.parser().parse_args(argv)
    return args.run(args, SparkSession.getActiveSession())


def test_table_commands(spark, tmp_path, archive, capsys):
    source, table, hours = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "hours")
    feed = fam.collections_feed(cli.read_clean_archive(spark, archive), "1 day", with_asset_key=True)
    encode_messages(feed, key_column=None).coalesce(3).write.text(str(source))
    stream = ["--files", str(source), "--available-now", "--files-per-trigger", "1"]
    manage(["fill", *stream, "--path", table, "--checkpoint-dir", str(tmp_path / "k1")])
    manage(["compact", "--path", table, "--everything"])
    assert values(read_metrics(spark, table), *COLLECTION_COLUMNS) == values(feed, *COLLECTION_COLUMNS)
    query = ["--collection", "c1", "--metric", "collection_total_sales_count", "--grain", "1 day", "--order", "ascending", "--limit", "2"]
    manage(["read", "--path", table, *query])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["collection"] for x in lines] == ["c1", "c1"] and lines[0]["timestamp"] < lines[1]["timestamp"]
    manage(["read", "--path", table, "--rejects"])
    assert capsys.readouterr().out == ""
    manage(["archive", *stream, "--path", hours, "--checkpoint-dir", str(tmp_path / "k2"), "--trigger", "1 second"])
    assert spark.read.text(hours).count() == feed.count()
    manage(["compact", "--path", hours])
    with pytest.raises(ValueError):
        manage(["fill", "--path", table, "--checkpoint-dir", str(tmp_path / "k3")])


def test_a_run_over_both_feeds_reads_raw_input_once(spark, archive):
    """Landing parses the archive; the feeds then read Parquet."""
    read = []

    def write(feed):
        read.extend(feed.inputFiles())
        feed.write.format("noop").mode("overwrite").save()

    run_batch(cli.read_clean_archive(spark, archive), ["1 hour"], write_global=write, write_collections=write)
    assert read and all(name.endswith(".parquet") for name in read)


def test_scratch_is_the_shared_folder_and_runs_leave_nothing_there(spark, archive):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(base)
    before = set(os.listdir(base))
    run(["all", "1 day", "--also", "7 days", "--raw-events-s3-uri", archive])
    assert set(os.listdir(base)) == before


def test_as_of_is_read_as_utc(spark):
    rows = fam.global_all_time(events(spark, event()), as_of=datetime(2024, 2, 1, 3))
    assert rows.select(rows.timestamp.cast("string")).first()[0] == "2024-02-01 03:00:00"


def test_messages_of_the_archive_are_json_lines(spark, archive):
    assert json.loads(spark.read.text(archive).first()["value"])["event"] in KINDS

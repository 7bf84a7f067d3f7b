"""The same queries as plain SQL, stated independently of the Spark plans.

Where the Spark side folds a join into one aggregate, the SQL keeps the join
(outer, cross, range), so that the two check each other.
"""

from __future__ import annotations

EVENTS = """
fields as (
  select *, try_cast(json_extract_string(props, '$.k') as integer) as k,
    case event_type
      when 'purchase' then 'item_sold'
      when 'signup' then 'item_listed'
      when 'click' then 'item_transferred'
      when 'view' then 'item_received_bid'
      else 'phx_reply' end as kind,
    'coll-' || cast(user_id % 15 as varchar) as slug,
    floor(value * 100) as cents
  from events),
typed as (
  select kind as event, kind as event_type, slug as collection_slug, ts as sent_at,
    case when kind = 'item_sold' then 'done' else 'open' end as status,
    case when k % 7 = 0 then null else 'item ' || cast(k as varchar) end as item_name,
    'https://x.example/' || cast(k as varchar) as item_url,
    'chain/' || cast(k as varchar) as item_nft_id,
    case when k % 3 = 0 then null else 'https://img.x.example/' || cast(k as varchar) end as image_url,
    'chain' as item_blockchain,
    case when kind = 'item_listed' then ts end as listing_date,
    case when kind = 'item_listed' then 'fixed' end as listing_type,
    'acct-' || cast(user_id as varchar) as from_account,
    case when kind = 'item_listed' then null else 'acct-' || cast(k as varchar) end as to_account,
    case when kind in ('item_sold', 'item_listed') and k % 11 <> 0 then 'ETH' end as payment_symbol,
    case when kind in ('item_sold', 'item_listed') and k % 11 <> 0 then cents / 2048 end as eth_price,
    case when kind in ('item_sold', 'item_listed') and k % 11 <> 0 then cents end as usd_price,
    case when k % 5 - 1 > 0 then k % 5 - 1 else 1 end as quantity
  from fields),
clean as (select * from typed where event <> 'phx_reply')"""

EARLY_EVENTS = EVENTS.replace(
    "where event <> 'phx_reply'", "where event <> 'phx_reply' and sent_at <= timestamp '2024-01-15 12:00:00'"
)

TRADES = """
kinds as (
  select *, case l_returnflag when 'A' then 'item_transferred' when 'N' then 'item_sold'
    else 'item_listed' end as kind
  from lineitem),
clean as (
  select kind as event, kind as event_type, 'supp-' || cast(l_suppkey as varchar) as collection_slug,
    l_shipdate as sent_at, 'part ' || cast(l_partkey as varchar) as item_name,
    'https://x.example/' || cast(l_partkey as varchar) as item_url,
    'part/' || cast(l_partkey as varchar) as item_nft_id, cast(null as varchar) as image_url,
    case when kind = 'item_transferred' then null else floor(l_extendedprice * 100) / 2048 end as eth_price,
    case when kind = 'item_transferred' then null else floor(l_extendedprice * 100) end as usd_price,
    cast(l_quantity as integer) as quantity
  from kinds)"""

SIDES = """
transfers as (select * from clean where event_type = 'item_transferred'),
sales as (select * from clean where event_type in ('item_sold', 'item_listed'))"""

AS_OF = "timestamp '2024-02-01 00:00:00'"
LOW, HIGH = "timestamp '2024-01-05 00:00:00'", "timestamp '2024-01-20 12:30:00'"
ASSET = "collection_slug, item_nft_id, item_name, item_url, image_url"
ASSET_OUT = "coalesce(item_name, item_nft_id) as asset_name, item_url as asset_url, image_url"
NO_ASSET = "cast(null as varchar) as asset_name, cast(null as varchar) as asset_url, cast(null as varchar) as image_url"
COLLECTION_OUT = 'metric, "timestamp", collection, value, asset_name, asset_url, image_url'
ASSET_TIES = "item_nft_id nulls last, item_name nulls last, item_url nulls last, image_url nulls last"


def window_start(grain: str) -> str:
    return f"time_bucket(interval '{grain}', sent_at, timestamp '1970-01-01')"


def window_end(grain: str) -> str:
    return f"{window_start(grain)} + interval '{grain}'"


def suffix(grain: str) -> str:
    return "__" + "_".join(grain.split())


def _with(*parts: str) -> str:
    return "with " + ",\n".join(part.strip() for part in parts) + "\n"


def long_global(source: str, metrics: dict[str, str], grain: str, time: str, collection: str) -> str:
    return "\nunion all\n".join(
        f"select '{name}{suffix(grain)}' as metric, {time} as \"timestamp\", "
        f"cast({value} as double) as value, {collection} as collection from {source}"
        for name, value in metrics.items()
    )


def long_collection(source: str, metrics: dict[str, str], grain: str, time: str, asset: str = NO_ASSET) -> str:
    return "\nunion all\n".join(
        f"select '{name}{suffix(grain)}' as metric, {time} as \"timestamp\", collection_slug as collection, "
        f"cast({value} as double) as value, {asset} from {source}"
        for name, value in metrics.items()
    )


GLOBAL_METRICS = {
    name: name
    for name in (
        "total_number_of_events",
        "total_transfers",
        "total_items_transferred",
        "total_sales",
        "total_eth_volume",
        "total_usd_volume",
    )
}


def global_sums(grain: str, source: str = "clean", end: str | None = None) -> str:
    transfer, sale = "event_type = 'item_transferred'", "event_type in ('item_sold', 'item_listed')"
    return f"""
g as (
  select {end or window_end(grain)} as t, count(*) as total_number_of_events,
    count(*) filter (where {transfer}) as total_transfers,
    coalesce(sum(quantity) filter (where {transfer}), 0) as total_items_transferred,
    count(*) filter (where {sale}) as total_sales,
    coalesce(sum(eth_price) filter (where {sale}), 0) as total_eth_volume,
    coalesce(sum(usd_price) filter (where {sale}), 0) as total_usd_volume
  from {source} where sent_at is not null group by 1)"""


def global_rows(grain: str) -> str:
    return long_global("g", GLOBAL_METRICS, grain, "t", "''")


def global_windowed(grain: str) -> str:
    return _with(EVENTS, global_sums(grain)) + global_rows(grain)


def top_collection_tables(grain: str) -> str:
    return f"""
cs as (
  select collection_slug, {window_end(grain)} as t, sum(usd_price) as usd_volume,
    count(*) as sales_count, min(usd_price) as floor_usd_price, avg(usd_price) as avg_usd_price
  from sales where sent_at is not null group by 1, 2),
cs_top as (
  select * from cs qualify row_number() over (
    partition by t order by usd_volume desc nulls last, collection_slug nulls last) <= 10),
ct as (
  select collection_slug, {window_end(grain)} as t, count(*) as transfers_count,
    sum(quantity) as items_transferred
  from transfers where sent_at is not null group by 1, 2),
ct_top as (
  select * from ct qualify row_number() over (
    partition by t order by transfers_count desc, collection_slug nulls last) <= 10)"""


def top_sales_rows(grain: str) -> str:
    names = ("usd_volume", "sales_count", "floor_usd_price", "avg_usd_price")
    metrics = {f"top_collections_by_sales_volume_{n}": n for n in names}
    return long_global("cs_top", metrics, grain, "t", "collection_slug")


def top_transfer_rows(grain: str) -> str:
    names = ("transfers_count", "items_transferred")
    metrics = {f"top_collections_by_transfers_volume_{n}": n for n in names}
    return long_global("ct_top", metrics, grain, "t", "collection_slug")


def global_feed(grain: str, events: str = EVENTS) -> str:
    parts = [global_rows(grain), top_sales_rows(grain), top_transfer_rows(grain)]
    return _with(events, SIDES, global_sums(grain), top_collection_tables(grain)) + "\nunion all\n".join(parts)


def global_feed_rows(grain: str) -> str:
    return f"{_with(EVENTS, SIDES, global_sums(grain), top_collection_tables(grain), _feed_part(grain))}"


def _feed_part(grain: str) -> str:
    parts = "\nunion all\n".join([global_rows(grain), top_sales_rows(grain), top_transfer_rows(grain)])
    return f"feed as ({parts})"


ALL_TIME_TABLES = """
ga as (
  select * from (select count(*) as total_transfers, sum(quantity) as total_items_transferred from transfers)
  cross join (select count(*) as total_sales, sum(coalesce(eth_price, 0)) as total_eth_volume,
    sum(coalesce(usd_price, 0)) as total_usd_volume from sales)
  cross join (select count(*) as total_number_of_events from clean)),
tops as (
  select collection_slug, sum(usd_price) as usd_price from sales group by 1
  order by 2 desc nulls last, 1 nulls last limit 10),
topt as (
  select collection_slug, count(*) as transfers_count from transfers group by 1
  order by 2 desc, 1 nulls last limit 10)"""


def global_all_time_rows() -> str:
    return long_global("ga", GLOBAL_METRICS, "all time", AS_OF, "''")


def top_all_time_rows() -> str:
    sales = {"top_collections_by_sales_volume_usd_price": "usd_price"}
    transfers = {"top_collections_by_transfers_volume_transfers_count": "transfers_count"}
    return (
        long_global("tops", sales, "all time", AS_OF, "collection_slug")
        + "\nunion all\n"
        + long_global("topt", transfers, "all time", AS_OF, "collection_slug")
    )


def collection_all_time_table() -> str:
    return """
ca as (
  select coalesce(t.collection_slug, s.collection_slug) as collection_slug, total_transfers,
    total_items_transferred, total_sales_count, total_assets_sold, total_eth_volume,
    total_usd_volume, floor_assets_usd_price, avg_assets_usd_price
  from (select collection_slug, count(*) as total_transfers, sum(quantity) as total_items_transferred
        from transfers group by 1) t
  full outer join (
    select collection_slug, count(*) as total_sales_count, sum(quantity) as total_assets_sold,
      sum(coalesce(eth_price, 0)) as total_eth_volume, sum(coalesce(usd_price, 0)) as total_usd_volume,
      min(usd_price) as floor_assets_usd_price, avg(usd_price) as avg_assets_usd_price
    from sales group by 1) s
  on t.collection_slug is not distinct from s.collection_slug)"""


def collection_all_time_rows() -> str:
    names = (
        "total_transfers",
        "total_items_transferred",
        "total_sales_count",
        "total_assets_sold",
        "total_usd_volume",
        "total_eth_volume",
        "floor_assets_usd_price",
        "avg_assets_usd_price",
    )
    return long_collection("ca", {f"collection_{n}": n for n in names}, "all time", AS_OF)


def assets_all_time_tables(n: int) -> str:
    return f"""
au as (
  select {ASSET}, sum(usd_price) as usd from sales group by {ASSET}
  qualify row_number() over (partition by collection_slug order by usd desc nulls last, {ASSET_TIES}) <= {n}),
ax as (
  select {ASSET}, count(*) as n from transfers group by {ASSET}
  qualify row_number() over (partition by collection_slug order by n desc, {ASSET_TIES}) <= {n})"""


def assets_all_time_rows() -> str:
    return (
        long_collection("au", {"collection_top_assets_by_usd_volume": "usd"}, "all time", AS_OF, ASSET_OUT)
        + "\nunion all\n"
        + long_collection("ax", {"collection_top_assets_by_transfers": "n"}, "all time", AS_OF, ASSET_OUT)
    )


def collections_all_time(events: str) -> str:
    return (
        _with(events, SIDES, collection_all_time_table(), assets_all_time_tables(50))
        + collection_all_time_rows()
        + "\nunion all\n"
        + assets_all_time_rows()
    )


def collection_tables(grain: str) -> str:
    end = window_end(grain)
    return f"""
cws as (
  select collection_slug, {end} as t, sum(usd_price) as total_usd_volume, count(*) as total_sales_count,
    sum(quantity) as total_assets_sold, min(usd_price) as floor_assets_usd_price,
    avg(usd_price) as avg_assets_usd_price
  from sales where sent_at is not null group by 1, 2),
cwt as (
  select collection_slug, {end} as t, count(*) as total_transfers, sum(quantity) as total_items_transferred
  from transfers where sent_at is not null group by 1, 2),
aws as (
  select {ASSET}, {end} as t, sum(usd_price) as usd from sales where sent_at is not null group by all),
aws_top as (
  select * from aws qualify row_number() over (
    partition by collection_slug, t order by usd desc nulls last, {ASSET_TIES}) <= 20),
awt as (
  select {ASSET}, {end} as t, count(*) as n from transfers where sent_at is not null group by all),
awt_top as (
  select * from awt qualify row_number() over (
    partition by collection_slug, t order by n desc, {ASSET_TIES}) <= 20)"""


def collection_sales_rows(grain: str) -> str:
    names = (
        "total_usd_volume",
        "total_sales_count",
        "total_assets_sold",
        "floor_assets_usd_price",
        "avg_assets_usd_price",
    )
    return long_collection("cws", {f"collection_{n}": n for n in names}, grain, "t")


def collection_transaction_rows(grain: str) -> str:
    names = ("total_transfers", "total_items_transferred")
    return long_collection("cwt", {f"collection_{n}": n for n in names}, grain, "t")


def asset_sales_rows(grain: str) -> str:
    return long_collection("aws_top", {"collection_top_assets_by_sales_volume": "usd"}, grain, "t", ASSET_OUT)


def asset_transfer_rows(grain: str, source: str = "awt") -> str:
    return long_collection(source, {"collection_top_assets_by_transfers": "n"}, grain, "t", ASSET_OUT)


def collections_feed(grain: str) -> str:
    parts = [
        collection_sales_rows(grain),
        collection_transaction_rows(grain),
        asset_sales_rows(grain),
        asset_transfer_rows(grain),
    ]
    return _with(EVENTS, SIDES, collection_tables(grain)) + "\nunion all\n".join(parts)


def on_collections(grain: str, rows: str) -> str:
    return _with(EVENTS, SIDES, collection_tables(grain)) + rows


def stream_collections(grain: str) -> str:
    rows = [collection_sales_rows(grain), collection_transaction_rows(grain), asset_transfer_rows(grain)]
    stored = on_collections(grain, "\nunion all\n".join(rows))
    return f"select * from ({stored}) where collection is not null"


def sold_windows(grain: str, top_n: int | None = None) -> str:
    top = ""
    if top_n is not None:
        top = f"""
  qualify row_number() over (partition by window_start, window_end
    order by usd_volume desc nulls last, collection_slug) <= {top_n}"""
    return f"""
sold as (select * from clean where event_type = 'item_sold'),
w as (
  select collection_slug, {window_start(grain)} as window_start, {window_end(grain)} as window_end,
    sum(usd_price) as usd_volume, count(*) as sales_count, min(usd_price) as floor_price,
    avg(usd_price) as avg_price
  from sold where sent_at is not null and collection_slug is not null group by 1, 2, 3{top})"""


IN_WINDOWS = """
select s.sent_at, s.collection_slug, s.item_name, s.item_url, s.image_url, s.usd_price,
  w.window_start, w.window_end
from (select * from sold where collection_slug in (select distinct collection_slug from w)) s
left join w on s.collection_slug = w.collection_slug
  and s.sent_at >= w.window_start and s.sent_at < w.window_end"""


def top_sales_by_price(grain: str) -> str:
    return (
        _with(EVENTS, sold_windows(grain))
        + f"""
select 'collection_top_assets_by_price{suffix(grain)}' as metric, window_end as "timestamp",
  collection_slug as collection, usd_price as value, item_name as asset_name, item_url as asset_url, image_url
from (
  select s.*, w.window_start, w.window_end from sold s join w on s.collection_slug = w.collection_slug
    and s.sent_at >= w.window_start and s.sent_at < w.window_end)
qualify row_number() over (partition by collection_slug, window_start, window_end
  order by usd_price desc nulls last, sent_at nulls last, {ASSET_TIES}) <= 20"""
    )


def top_collection_stats(grain: str) -> str:
    metrics = {
        "collection_floor_price": "floor_price",
        "collection_total_volume": "usd_volume",
        "collection_avg_assets_price": "avg_price",
        "collection_total_sales": "sales_count",
    }
    return _with(EVENTS, sold_windows(grain)) + long_collection("w", metrics, grain, "window_end")


LATE = """
(select max(date_trunc('milliseconds', sent_at)) - interval '3 minutes' from clean)"""


def late_drop(grain: str) -> str:
    # The second copy counts only in windows that end after the watermark.
    twice = f"""
arrived as (
  select * from clean
  union all
  select * from clean where {window_end(grain)} > {LATE.strip()})"""
    return _with(EVENTS, twice, global_sums(grain, source="arrived")) + global_rows(grain)


def sliding(source: str = "clean") -> str:
    # Each hour-long window that starts on a half hour and covers the event.
    return f"""
slid as (
  select *, time_bucket(interval '30 minutes', sent_at, timestamp '1970-01-01')
    - n * interval '30 minutes' + interval '1 hour' as slid_end
  from {source}, (select unnest([0, 1]) as n))"""


CLEAN_COLUMNS = (
    "event, event_type, collection_slug, sent_at, status, item_name, item_url, item_nft_id, image_url, "
    "item_blockchain, listing_date, listing_type, from_account, to_account, payment_symbol, eth_price, "
    "usd_price, quantity"
)
CLEAN = _with(EVENTS) + f"select {CLEAN_COLUMNS} from clean"
RAW_FIELDS = (
    _with(EVENTS)
    + """
select event, 'collection:' || collection_slug as topic, event_type,
  strftime(sent_at, '%Y-%m-%dT%H:%M:%S.%f') as sent_at from typed"""
)
IN_RANGE = f"sent_at > {LOW} and sent_at <= {HIGH}"
TRANSFER_RANKS = "top_collections_by_transfers_volume_transfers_count__1_hour"


def _all_of(queries: list[str], columns: str) -> str:
    return "\nunion all\n".join(f"select {columns} from ({query})" for query in queries)


def _sold_only(query: str) -> str:
    return query.replace("event_type in ('item_sold', 'item_listed')", "event_type = 'item_sold'")


EVENTS_IN_RANGE = EVENTS.replace("from events", f"from (select * from events where ts between {LOW} and {HIGH})")


def exploration_tables(grain: str) -> str:
    return f"""
ev as (select *, {window_end(grain)} as t from clean where sent_at is not null),
sv as (select t, collection_slug, sum(usd_price) as usd from ev where event_type = 'item_sold' group by 1, 2)"""


def exploration_rows(grain: str) -> str:
    end = suffix(grain)
    return f"""
union all
select 'total_volume{end}', t, sum(usd_price), '' from ev where event_type = 'item_sold' group by t
union all
select 'transfers_count{end}', t, count(*), '' from ev where event_type = 'item_transferred' group by t
union all
select 'items_transferred_count{end}', t, sum(quantity), '' from ev where event_type = 'item_transferred' group by t
union all
select 'top_collections_by_volume{end}', t, usd, collection_slug from sv
qualify row_number() over (partition by t order by usd desc nulls last, collection_slug nulls last) <= 10"""


def oracle_sql() -> dict[str, str]:
    windowed = ["14 days", "7 days", "1 day", "12 hours", "1 hour"]
    global_all_time = (
        _with(EVENTS, SIDES, ALL_TIME_TABLES) + global_all_time_rows() + "\nunion all\n" + top_all_time_rows()
    )
    feed_1h = global_feed_rows("1 hour")
    o = {
        "scan_archive": CLEAN,
        "message_files": CLEAN,
        "archive_time_range": CLEAN + f" where sent_at >= {LOW} and sent_at <= {HIGH}",
        "stream_scan": CLEAN,
        "clean_events": CLEAN,
        "clean_events_json": CLEAN,
        "envelope_json": RAW_FIELDS,
        "stream_raw_append": RAW_FIELDS,
        "parse_by_path": _with(EVENTS) + f"select {CLEAN_COLUMNS.removeprefix('event, ')} from typed",
        "time_range": CLEAN + f" where sent_at >= {LOW} and sent_at <= {HIGH}",
        "transferred_items": CLEAN + " where event_type = 'item_transferred'",
        "sales_items": CLEAN + " where event_type in ('item_sold', 'item_listed')",
        "encode_messages": global_windowed("1 day"),
        "encode_keyed": on_collections(
            "1 day",
            f'select collection as key, metric, "timestamp", value from ({collection_sales_rows("1 day")})',
        ),
        "archive_hourly": _with(EVENTS)
        + """
select cast(year(sent_at) as integer) as year, cast(month(sent_at) as integer) as month,
  cast(day(sent_at) as integer) as day, cast(hour(sent_at) as integer) as hour,
  count(*) as messages, count(*) filter (where event = 'item_transferred') as transfers
from typed group by 1, 2, 3, 4""",
        "upsert_global": f"""
select metric, "timestamp", value, collection from (
  select *, 1 as run from ({global_feed("1 day", EARLY_EVENTS)})
  union all
  select *, 2 as run from ({global_feed("1 day")}))
where collection is not null  -- the table has no row without a key
qualify row_number() over (partition by metric, collection, "timestamp" order by run desc) = 1""",
        "upsert_collections": f"select * from ({collections_feed('1 day')}) where collection is not null",
        "store_compacted": global_windowed("1 hour"),
        "messages_to_store": f"select * from ({collections_feed('1 day')}) where collection is not null",
        "global_all_time": _with(EVENTS, SIDES, ALL_TIME_TABLES) + global_all_time_rows(),
        "collection_all_time": _with(EVENTS, SIDES, collection_all_time_table()) + collection_all_time_rows(),
        "top_collections_all_time": _with(EVENTS, SIDES, ALL_TIME_TABLES) + top_all_time_rows(),
        "top_assets_all_time": _with(EVENTS, SIDES, assets_all_time_tables(20)) + assets_all_time_rows(),
        "global_sliding_1h_30m": _with(EVENTS, sliding(), global_sums("1 hour", "slid", "slid_end"))
        + global_rows("1 hour"),
        "asset_transfers_1h": on_collections("1 hour", asset_transfer_rows("1 hour")),
        "top_assets_by_sales_1d": on_collections("1 day", asset_sales_rows("1 day")),
        "top_assets_by_transfers_1d": on_collections("1 day", asset_transfer_rows("1 day", "awt_top")),
        "global_feed_1h": global_feed("1 hour"),
        "collections_feed_1h": collections_feed("1 hour"),
        "global_feed_all_time": global_all_time,
        "collections_feed_all_time": collections_all_time(EVENTS),
        "global_feed_every_grain": _all_of(
            [global_all_time, *[global_feed(g) for g in windowed]], 'metric, "timestamp", value, collection'
        ),
        "collections_feed_every_grain": _all_of(
            [collections_all_time(EVENTS), *[collections_feed(g) for g in windowed]], COLLECTION_OUT
        ),
        "trades_global_feed_7d": global_feed("7 days", TRADES),
        "trades_collections_feed_all_time": collections_all_time(TRADES),
        "global_feed_sold_only": _sold_only(global_feed("1 day")),
        "global_feed_sold_only_partials": _sold_only(global_feed("1 day")),
        "collections_feed_sold_only": _sold_only(collections_feed("1 day")),
        "collections_feed_sold_only_partials": _sold_only(collections_feed("1 day")),
        "landed_feed": global_feed("1 day", EVENTS_IN_RANGE),
        "exploration_metrics": _with(EVENTS, global_sums("1 hour"), exploration_tables("1 hour"))
        + global_rows("1 hour")
        + exploration_rows("1 hour"),
        "collection_profile": f"select * from ({top_collection_stats('1 hour')})\nunion all\n"
        f"select * from ({top_sales_by_price('1 hour')})",
        "price_quantiles": _with(EVENTS)
        + "\nunion all\n".join(
            f"select cast({p} as double) as share, round(quantile_cont(usd_price, {p}), 6) as usd_price from clean"
            for p in (0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)
        ),
        "event_type_counts": _with(EVENTS) + "select event_type, count(*) as count from clean group by 1",
        "event_type_counts_priced": _with(EVENTS)
        + "select event_type, count(*) as count from clean where usd_price is not null group by 1",
        "time_extent": _with(EVENTS)
        + "select min(sent_at) as first_event_at, max(sent_at) as last_event_at from clean",
        "range_profile": _with(EVENTS)
        + f"""
select event_type, min(sent_at) as first_event_at, max(sent_at) as last_event_at, count(*) as count,
  cast(sum(quantity) as bigint) as total_number_of_assets
from clean where {IN_RANGE} and quantity is not null group by 1""",
        "window_profile": _with(EVENTS)
        + f"""
select {window_start("1 hour")} as window_start, {window_end("1 hour")} as window_end,
  min(sent_at) as first_event_at, max(sent_at) as last_event_at, count(*) as number_of_events,
  count(*) filter (where event_type = 'item_transferred') as number_of_transfers,
  count(*) filter (where event_type <> 'item_transferred') as number_of_not_transfers,
  cast(sum(quantity) filter (where event_type = 'item_transferred') as double) as total_assets_transferred,
  cast(sum(quantity) as bigint) as number_of_assets
from clean where sent_at is not null group by 1, 2""",
        "window_transactions": _with(EVENTS, SIDES)
        + f"""
select {window_start("1 hour")} as window_start, {window_end("1 hour")} as window_end,
  count(*) as transfers_count, cast(sum(quantity) as bigint) as items_transferred_count
from transfers where sent_at is not null group by 1, 2""",
        "window_sales": _with(EVENTS)
        + f"""
select {window_start("1 hour")} as window_start, {window_end("1 hour")} as window_end,
  sum(usd_price) as usd_volume, count(*) as sales_count
from clean where event_type = 'item_sold' and sent_at is not null group by 1, 2""",
        "sales_of_top_collections": _with(EVENTS, sold_windows("1 hour"))
        + f"select {CLEAN_COLUMNS} from sold where collection_slug in (select collection_slug from w)",
        "sales_of_top_3_collections": _with(EVENTS, sold_windows("14 days", 3))
        + f"select {CLEAN_COLUMNS} from sold where collection_slug in (select collection_slug from w)",
        "sales_in_top_windows": _with(EVENTS, sold_windows("1 hour")) + IN_WINDOWS,
        "sales_in_top_10_windows": _with(EVENTS, sold_windows("1 day", 10)) + IN_WINDOWS,
        "top_sales_by_price": top_sales_by_price("14 days"),
        "top_collection_stats": top_collection_stats("1 hour"),
        "metric_value_counts_all": _with(EVENTS, global_sums("1 hour"))
        + f"select value, count(*) as count from ({global_rows('1 hour')}) group by 1",
        "metric_value_counts": _with(EVENTS, global_sums("1 hour"))
        + f"select value, count(*) as count from ({global_rows('1 hour')}) where value < 2000 group by 1",
        "metric_name_counts": feed_1h + "select metric, count(*) as count from feed group by 1",
        "metric_summary": _with(EVENTS, global_sums("1 hour"))
        + """
select count(v) as count, count(*) filter (where v is null) as null_count, avg(v) as mean,
  round(stddev_samp(v), 6) as std, min(v) as min, max(v) as max
from (select cast(total_transfers as double) as v from g)""",
        "metric_quartiles": _with(EVENTS, global_sums("1 hour"))
        + """
select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as q2, quantile_cont(v, 0.75) as q3
from (select cast(total_transfers as double) as v from g)""",
        "stream_global_1h": global_windowed("1 hour"),
        "stream_global_5m": global_windowed("5 minutes"),
        "stream_no_watermark": global_windowed("1 day"),
        "stream_collections_1h": stream_collections("1 hour"),
        "stream_late_drop": late_drop("1 hour"),
        "stream_sliding_collection": _with(EVENTS)
        + """
select e - interval '1 minute' as window_start, e as window_end, collection_slug, count(*) as count
from (
  select collection_slug, time_bucket(interval '30 seconds', sent_at, timestamp '1970-01-01')
    - n * interval '30 seconds' + interval '1 minute' as e
  from clean, (select unnest([0, 1]) as n) where sent_at is not null)
group by 1, 2, 3""",
        "stream_to_store": on_collections(
            "1 day",
            f"""
select metric, "timestamp", collection, value from ({collection_sales_rows("1 day")}) r
where metric = 'collection_total_usd_volume__1_day' and collection is not null
qualify rank() over (partition by collection order by "timestamp" desc) = 1
order by value desc nulls last, collection limit 10""",
        ),
        "serve_global": _with(EVENTS, global_sums("1 hour"))
        + f"""
select metric, "timestamp", value, collection from ({global_rows("1 hour")})
where metric = 'total_transfers__1_hour' and "timestamp" >= {LOW} and "timestamp" <= {HIGH}""",
        "serve_global_limit": feed_1h
        + """
select metric, "timestamp", value, collection from feed
order by metric, collection, "timestamp" desc limit 100""",
        "serve_collection": on_collections(
            "1 day",
            f"""
select {COLLECTION_OUT} from ({collection_sales_rows("1 day")})
where metric = 'collection_total_usd_volume__1_day' and collection = 'coll-3'
  and "timestamp" >= {LOW} and "timestamp" <= {HIGH}""",
        ),
        "indicator_latest": _with(EVENTS, global_sums("1 hour"))
        + f"""
select metric, "timestamp", value from ({global_rows("1 hour")})
where metric = 'total_usd_volume__1_hour' order by "timestamp" desc limit 1""",
        "latest_per_group": feed_1h
        + f"""
select r.metric, r."timestamp", r.value, r.collection
from (select * from feed where metric = '{TRANSFER_RANKS}') r
join (select collection, max("timestamp") as t from feed where metric = '{TRANSFER_RANKS}' group by 1) m
  on r.collection = m.collection and r."timestamp" = m.t""",
        "latest_top_table": feed_1h
        + f"""
select metric, "timestamp", value, collection from feed where metric = '{TRANSFER_RANKS}'
qualify rank() over (partition by collection order by "timestamp" desc) = 1
order by value desc nulls last, collection limit 10""",
        "series_by_hue": on_collections(
            "1 day",
            f"""
select "timestamp", value, asset_name as hue from ({asset_sales_rows("1 day")})
where collection = 'coll-3'
qualify row_number() over (partition by asset_name order by "timestamp" desc, value desc nulls last) <= 5""",
        ),
        "page_indicators": _with(EVENTS, SIDES, ALL_TIME_TABLES)
        + f"""
select metric, "timestamp", value from ({global_all_time_rows()})
where metric <> 'total_eth_volume__all_time'""",
        "display_table": _with(EVENTS, SIDES, ALL_TIME_TABLES.replace("limit 10", "limit 20"))
        + """
select '<a target=''_Self'' href=''/collections?collection=' || collection_slug || '''>'
  || collection_slug || '</a>' as collection, format('{:,}', cast(usd_price as bigint)) as volume
from tops where collection_slug is not null""",
    }
    for label, grain in {"1h": "1 hour", "12h": "12 hours", "1d": "1 day", "7d": "7 days", "14d": "14 days"}.items():
        o[f"global_windowed_{label}"] = global_windowed(grain)
    for label, grain in {"1h": "1 hour", "1d": "1 day"}.items():
        o[f"collection_sales_{label}"] = on_collections(grain, collection_sales_rows(grain))
        o[f"collection_transactions_{label}"] = on_collections(grain, collection_transaction_rows(grain))
        tops = _with(EVENTS, SIDES, top_collection_tables(grain))
        o[f"top_collections_sales_{label}"] = tops + top_sales_rows(grain)
        o[f"top_collections_transfers_{label}"] = tops + top_transfer_rows(grain)
    return o

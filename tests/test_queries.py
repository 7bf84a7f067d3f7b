"""Every registered query against its SQL, on a copy of the given events with
NULLs in every column, unreadable fields, negative values and one user with a
third of all rows."""

from pathlib import Path

import pytest

import __spark_entry__ as entries
from check_queries import canonical, connect
from tallyhouse.registry import oracles, queries

GIVEN = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not GIVEN.exists(), reason="the given tables are not here")

HOSTILE = """
select event_id,
  case when event_id % 37 = 0 then null else ts end as ts,
  case when event_id % 3 = 0 then 7 when event_id % 41 = 0 then null else user_id end as user_id,
  case when event_id % 43 = 0 then null else event_type end as event_type,
  case when event_id % 47 = 0 then null when event_id % 53 = 0 then -value else value end as value,
  case when event_id % 59 = 0 then null when event_id % 61 = 0 then '{"k": "x"}'
    when event_id % 67 = 0 then '{}' else props end as props
from events"""
TRADES = """
select * replace (
  case when l_linenumber = 1 then 3 else l_suppkey end as l_suppkey,
  case when l_orderkey % 50 = 0 then null else l_shipdate end as l_shipdate)
from lineitem"""


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hostile")
    given = connect(str(GIVEN))
    given.sql(f"copy ({HOSTILE}) to '{folder}/events.parquet'")
    given.sql(f"copy ({TRADES}) to '{folder}/lineitem.parquet'")
    return str(folder), connect(str(folder))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, data, name):
    folder, sql = data
    ours = queries.queries()[name](spark, folder).toPandas()
    theirs = sql.sql(oracles.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_every_query_has_its_sql():
    assert queries.queries().keys() == oracles.oracle_sql().keys()
    assert queries.queries().keys() <= entries.queries().keys()


def test_entry(spark):
    assert entries.entry(spark).columns == ["metric", "timestamp", "value", "collection"]

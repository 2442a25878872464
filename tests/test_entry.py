"""Every registered query against its SQL on the smallest tables."""

import datetime
import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from loglantern.plans import catalog

SF = "/root/testdata/sf0.001"
STREAMS = ("stream_captures", "stream_outbox", "stream_state", "quiet_close", "quiet_close_by_clock", "stream_late_lines",
           "quiet_close_text", "stream_redelivered", "stream_journal_captures", "stream_model_requests", "stream_text_captures_by_host",
           "stream_retention")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) >= {"capture_id", "end_reason"}


def test_every_query_has_sql():
    without = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} - set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert without == set()


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in STREAMS])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(row[c] for c in columns) for row in df.collect())
    assert got
    if name in entry.oracle_sql():
        result = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = Counter(tuple(row[names.index(c)] for c in columns) for row in result.fetchall())
        assert not any(isinstance(v, datetime.datetime) for row in list(want)[:5] for v in row)
        assert got == want


def test_clock_query(spark, duck):
    """Every capture closes once: none again in batches of another checkpoint, and none is left open before the first tick."""
    got = Counter(tuple(r) for r in entry.queries()["quiet_close_by_clock"](spark, SF).collect())
    assert got == Counter(duck.execute(entry.oracle_sql()["quiet_close_by_clock"]).fetchall())

"""Streams run to their end over a table of several overlapping files give what the batch queries give."""

import os

import duckdb
import pytest

from arbolita import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """The events in three files: late ones, all times, early ones."""
    at = tmp_path_factory.mktemp("parts")
    os.mkdir(f"{at}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE TABLE events AS SELECT *, ntile(3) OVER (ORDER BY ts) AS third FROM '{DATA}/events.parquet'")
    for k, where in enumerate(["third = 3", "event_id % 2 = 0 AND third < 3", "event_id % 2 = 1 AND third < 3"]):
        c.execute(f"COPY (SELECT * EXCLUDE third FROM events WHERE {where}) TO '{at}/events.parquet/part-{k}.parquet' (FORMAT parquet)")
        os.utime(f"{at}/events.parquet/part-{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    return str(at), c


def test_sessions_against_batch_sql(spark, parts):
    at, c = parts
    want = c.sql(f"SELECT user_id, first_ts, n FROM ({registry.oracle_sql()['event_sessions']})").fetchall()
    got = [(r.user_id, r.start, r.n) for r in registry.queries()["stream_sessions"](spark, at).collect()]
    assert sorted(got) == sorted(want) and sum(n for *_, n in got) == c.sql("SELECT count(*) FROM events").fetchall()[0][0]


def test_distinct_loses_no_late_file(spark, parts):
    at, c = parts
    want = c.sql(f"SELECT event_id, user_id, event_type FROM ({registry.oracle_sql()['stream_distinct']})").fetchall()
    assert sorted(tuple(r) for r in registry.queries()["stream_distinct"](spark, at).collect()) == sorted(want)

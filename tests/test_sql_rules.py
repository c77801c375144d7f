"""Queries and their SQL on rows that few tables hold."""

from datetime import datetime, timedelta

import duckdb
import pytest

from siteloom.registry import ORACLES, QUERIES


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes tables to a folder; returns a function that runs a query there both ways."""

    def run(name, **given):
        con = duckdb.connect()
        for table, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = QUERIES[name](spark, str(tmp_path))
        quoted = ", ".join(f'"{c}"' for c in got.columns)
        return sorted(map(tuple, got.collect())), sorted(con.sql(ORACLES[name]).project(quoted).fetchall())

    return run


def _events(values):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i), 1, "view", float(x), '{"k": 1}') for i, x in enumerate(values)]
    return rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_backoff_state_where_the_fastest_took_no_time(tables):
    got, want = tables("backoff_state", events=_events([3, 0, 9, 5]))
    assert got == want == [(1, 0.0, 0.0, False)]


def test_stream_slowdown_where_the_fastest_took_no_time(tables):
    got, want = tables("stream_slowdown", events=_events([3, 0, 9, 5]))
    assert got == want == [("1", 1, 1.0, 0.0, False), ("1", 2, 1.0, 0.0, False), ("1", 3, 1.0, 0.0, False), ("1", 4, 1.0, 0.0, False)]


def test_page_meta_of_references_without_semicolon(tables):
    html = "<h1>a &amp;&copy b &amp;amp &ampx &am ver&amp</h1><a href=/x>y</a><meta name=k content=v>"
    got, want = tables("page_meta", pages=([(1, "https://h.org/", html)], "page_id long, url string, html string"))
    assert got == want == [(1, "a &© b &amp &x &am ver&", 1, 1)]

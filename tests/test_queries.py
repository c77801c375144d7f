import duckdb
import pytest

from siteloom.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dict):
        return tuple(_plain(x) for x in value.values())
    if isinstance(value, tuple):
        return tuple(_plain(x) for x in value)
    return [_plain(x) for x in value] if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir)
    order = sorted(got.columns)
    rows = sorted(repr([_plain(x) for x in r]) for r in got.select(*order).collect())
    assert rows
    if name not in ORACLES:
        return
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == order
    quoted = ", ".join(f'"{c}"' for c in order)
    assert sorted(repr([_plain(x) for x in r]) for r in want.project(quoted).fetchall()) == rows

"""Every registered query of the row format against DuckDB, on the smallest data there is."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from quillrow.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _plain(x):
    if isinstance(x, list | tuple):
        return tuple(map(_plain, x))
    if isinstance(x, decimal.Decimal | int | float) and not isinstance(x, bool):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, datetime.date | datetime.time) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = [dict(zip(df.columns, r, strict=True)) for r in df.collect()]
    assert rows
    if name in ORACLE_SQL:
        found = duck.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(df.columns)
        order = sorted(df.columns)
        expected = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
        key = lambda r: tuple(repr(_plain(r[c])) for c in order)
        assert sorted(map(key, rows)) == sorted(map(key, expected))


@pytest.mark.parametrize("name", ["roundtrip_duration", "roundtrip_duration_interval"])
def test_durations_of_large_keys(spark, duck, tmp_path, name):
    """60 times sf0.1 has keys whose milliseconds are beyond the 31 bits of a duration's field."""
    large = f"SELECT * REPLACE (o_orderkey * 100003 AS o_orderkey) FROM '{DATA}/orders.parquet'"
    duck.sql(f"COPY ({large}) TO '{tmp_path}/orders.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert con.sql("SELECT max(o_orderkey) * 1000 FROM orders").fetchall()[0][0] > 2**31
    found = {(r["id"], r["value"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert found == set(con.sql(f"SELECT id, value FROM ({ORACLE_SQL[name]})").fetchall())

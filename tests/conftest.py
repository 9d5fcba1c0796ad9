import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from evidlake.session import local_session, ship

    s = local_session(8, 4)
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    import datetime
    import decimal

    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


@pytest.fixture(scope="session")
def same(spark, sf, oracle):
    """Runs a query on both engines and compares columns and rows."""

    def check(query, sql):
        df = query(spark, sf)
        cols = sorted(df.columns)
        cur = oracle.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows_of(df) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())

    return check

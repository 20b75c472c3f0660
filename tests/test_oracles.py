"""Every registered query of the library against its oracle in DuckDB."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from lexmill import plans
from lexmill.registry import ORACLES, QUERIES

plans.load()
DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert rows
        return
    got = duck.sql(ORACLES[name])
    names = got.columns
    want = sorted((tuple(plain(dict(zip(names, x, strict=True))[c]) for c in cols) for x in got.fetchall()), key=str)
    assert sorted(names) == cols and rows == want

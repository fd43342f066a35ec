"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import decimal
import glob
import math
import os

import pytest

from settlematch.plans.queries import MAKERS, ORACLE_SQL, QUERIES, Inputs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 9)
    if isinstance(v, dt.datetime):
        return v.date().isoformat() if v.time() == dt.time() else v.isoformat()
    return v.isoformat() if isinstance(v, dt.date) else v


def order(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def inputs(spark):
    """Tables that the queries build on are made once for all of them."""
    return Inputs(spark, SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(inputs, duck, name):
    df = MAKERS[name](inputs)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=order)
    if name not in ORACLE_SQL:
        assert len(set(columns)) == len(columns)
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=order)

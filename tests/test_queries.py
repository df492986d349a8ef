"""Each query against its SQL on the small tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return None if isinstance(v, float) and math.isnan(v) else v


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in table), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in entry.oracle_sql():
        want = db.execute(entry.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, want.fetchall())

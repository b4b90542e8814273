"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import glob
from collections import Counter

import duckdb
import pytest

from concord.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {p.rsplit('/', 1)[-1][:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows, order):
    return Counter(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, DATA)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert plain(got.select(*order).collect(), range(len(order))) == plain(want.fetchall(), [want.columns.index(c) for c in order])

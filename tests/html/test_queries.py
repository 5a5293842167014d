"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from tagweave.plans.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def rows(frame, cols):
    return sorted(tuple("%.6g" % x if isinstance(x, float) else str(x) for x in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = sql.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)

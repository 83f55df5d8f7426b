"""The registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from eventloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = duck.execute(queries.ORACLE_SQL[name])
    there = [d[0] for d in cur.description]
    assert sorted(there) == columns
    want = sorted(tuple(str(r[there.index(c)]) for c in columns) for r in cur.fetchall())
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == want and got

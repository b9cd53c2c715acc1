"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from millrace.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def tidy(rows):
    return sorted(tuple("null" if v is None else repr(float(f"{v:.12g}")) if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in names)
    assert tidy(map(tuple, df.select(*(f"`{c}`" for c in names)).collect())) == tidy(duck.sql(f"select {quoted} from ({ORACLE[name]}) q").fetchall())

"""Every registered training-data query with SQL against that SQL (sf0.001)."""

import os

import duckdb
import pytest

from trapwise.llm import queries
from trapwise.sources.tables import TABLES

from ..conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    res = duck.execute(queries.ORACLE[name])
    cols = [x[0] for x in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, map(tuple, df.collect())) == rows(cols, res.fetchall())

"""Every registered job against its brute-force DuckDB oracle (sf0.001)."""

import math
import os

import duckdb
import pytest

from trapwise.plans import registry
from trapwise.sources.tables import TABLES

from .conftest import SMALL


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_job_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(registry.ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    types = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    st = {f.name: types.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    dt = {d[0]: str(d[1]) for d in res.description}
    assert st == {c: dt[c] for c in st}, f"column types differ: {st} vs {dt}"
    assert len(srows) == len(orows)
    assert _rows(df.columns, srows) == _rows(ocols, orows)


def test_every_job_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE)

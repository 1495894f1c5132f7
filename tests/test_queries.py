"""Every query with SQL gives the same rows in DuckDB, over the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from quillmill.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    other = sql.sql(ORACLES[name])
    places = [list(other.columns).index(c) for c in columns]
    assert sorted(other.columns) == columns
    assert mine == sorted((tuple(plain(r[i]) for i in places) for r in other.fetchall()), key=repr)

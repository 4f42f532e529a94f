"""Every registered query against its SQL on the smallest tables, in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import epigrid.plans.gate_queries  # noqa: F401
import epigrid.plans.io_queries  # noqa: F401
import epigrid.plans.more_queries  # noqa: F401
import epigrid.plans.run_queries  # noqa: F401
import epigrid.plans.spatial_queries  # noqa: F401
from epigrid.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def cells(df):
    show = lambda x: "null" if pd.isna(x) else repr(round(float(x), 6) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(show(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = db.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert cells(got) == cells(want)
    else:
        assert len(got)

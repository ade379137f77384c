"""Every registered query that has SQL against DuckDB on the smallest tables;
the others have to run and give rows."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from phenoscope.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

registry.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(cell(x) for x in v)
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) or v is pd.NA:
            return None
        if isinstance(v, (bool, np.bool_)):
            return int(v)
        if isinstance(v, (float, np.floating, int, np.integer)):
            return round(float(v), 6)
        return str(v)

    return sorted((tuple(map(cell, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    differing = [(x, y) for x, y in zip(a, b) if x != y]
    assert not differing, differing[:3]

"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import math
import os
from glob import glob

import duckdb
import pytest

from arbolita import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return str(x) if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(sorted(rel.columns))} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = repr
    assert sorted((tuple(map(_plain, r)) for r in got), key=key) == sorted((tuple(map(_plain, r)) for r in want), key=key)

"""The queries of this subpackage that have SQL give DuckDB's rows on the smallest tables."""

import os
from glob import glob

import duckdb
import pytest

from arbolita.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for p in glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = Q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rel = c.sql(Q.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({Q.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(df.select(columns).collect()) == plain(want)

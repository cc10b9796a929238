"""The operators' queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(x) for x in columns]
    assert sorted(repr(tuple(r[x] for x in columns)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in found.fetchall())

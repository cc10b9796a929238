"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from millrace.plans import catalog, extensions, store_queries  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    return (round(v, 6) if math.isfinite(v) else str(v)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(norm(r[k]) for k in at)) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(catalog.queries()) <= set(__spark_entry__.queries())

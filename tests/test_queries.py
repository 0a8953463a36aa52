"""Every query of the library proper against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    """DuckDB with the tables as views."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def shown(v):
    """A value for comparison."""
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = df.collect()
    columns = sorted(df.columns)
    if name not in registry.oracle_sql():
        return
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in rows) == want


def test_flagship_has_rows(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0

"""Every registered query against its SQL, and that the entry points work."""

import glob
import importlib
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)

    def text(v):
        if pd.isna(v):
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and v.dtype.kind in "iuf" else str(v)

    a, b = (x[cols].astype(object).map(text).sort_values(cols, ignore_index=True) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    if sql := registry.oracle_sql().get(name):
        same(got, con.execute(sql).df())
    else:
        assert len(got.columns) and not got.isna().all(axis=None)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()

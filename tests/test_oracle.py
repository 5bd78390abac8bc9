"""Every query against its SQL in DuckDB, on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spindrift.plans import queries as core

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows), sorted(cols)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    want = con.sql(core.SQL[name])
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(want.fetchall(), want.columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert "primary_type" in df.columns and df.count() > 0


def test_llm_is_not_imported_by_the_rest():
    root = os.path.join(os.path.dirname(entry.__file__), "spindrift")
    for folder, _, files in os.walk(root):
        if "llm" in folder.split(os.sep):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, f), encoding="utf-8").read()

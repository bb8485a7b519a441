"""Every query against its SQL on the smallest tables, and the entry module's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioforge.plans import oracle, problems, reference

QUERIES = problems.QUERIES | reference.QUERIES


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple("null" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    r = con.execute(oracle.SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert table(df.columns, [tuple(x) for x in df.collect()]) == table(cols, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle.SQL)))
def test_query_runs(spark, folder, name):
    QUERIES[name](spark, folder).collect()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_idx", "zone_pos", "sub_pos"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

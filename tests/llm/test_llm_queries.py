import glob
import os

import duckdb
import pytest

from folioforge.llm.queries import ORACLE, QUERIES


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    if name in ORACLE:
        con = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        r = con.execute(ORACLE[name])
        assert table(df.columns, rows) == table([d[0] for d in r.description], r.fetchall())

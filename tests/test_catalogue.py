"""Every registered reference query against its SQL in DuckDB, at the smallest size."""

import glob
import os

import duckdb
import pytest

from knotwork.plans import queries as catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in (r[k] for k in order)) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, D)
    got = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())

"""Findings of round 5."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from knotwork.matrix import COO, SparseMatrix
from knotwork.operators import arrays as A
from knotwork.operators import metapath as H
from knotwork.operators import product as P
from knotwork.plans import queries as catalogue
from knotwork.storage import materialize


def _random(spark, rows, cols, n, seed, odd=False):
    rng = random.Random(seed)
    got = [(rng.randrange(rows), rng.randrange(cols), float(rng.randrange(-3, 4))) for _ in range(n)]
    if odd:
        got += [(None, 1, 2.0), (2, None, 1.0), (3, 1, None), (None, 2, None), (-5, 3, 1.0), (4, 3, float("inf"))]
    return SparseMatrix(spark.createDataFrame(got, COO), rows, cols)


def _key(df):
    return sorted(((i is None, i or 0, j is None, j or 0, None if v is None else str(v + 0.0)) for i, j, v in df.collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"STEP": 8, "PLACES": 16}, {"PLACES": 0, "HELD": 8, "BATCH": 4}])
def test_products_in_arrays_are_those_of_rows(spark, monkeypatch, limits):
    """Blocks, heavy rows over columns, repeats, cancelling sums, nulls and parts of cells."""
    for name, n in limits.items():
        monkeypatch.setattr(A, name, n)
    a, b = _random(spark, 40, 30, 300, 1, odd=True), _random(spark, 30, 50, 250, 2, odd=True)
    heavy = SparseMatrix(a.df.unionByName(spark.range(30).select(F.lit(7).cast("long").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")).crossJoin(spark.range(9)).drop("id")), 40, 30)
    for share, left in ((None, a), (400, heavy)):
        with monkeypatch.context() as m:
            if share:
                m.setattr(P, "SHARE", share)
            assert _key(A.array_spgemm(left, b).df) == _key(P.spgemm(left, b).df)
    none = SparseMatrix(spark.createDataFrame([], COO), 30, 50)
    assert A.array_spgemm(a, none).df.collect() == [] == A.array_spgemm(none.transpose(), _random(spark, 30, 5, 9, 3)).df.collect()
    monkeypatch.setattr(A, "LONGEST", 3)
    assert _key(A.array_spgemm(a, b).df) == _key(P.spgemm(a, b).df)


def test_paths_are_multiplied_in_arrays(spark, monkeypatch):
    """No product of the path is a row, and no part that nothing is multiplied with is sketched."""
    df = catalogue.queries()["metapath_cheapest"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    kept = []
    monkeypatch.setattr(H, "materialize", lambda df: kept.append(df) or df)
    mats = [_random(spark, 9, 9, 20, k) for k in range(4)]
    assert len(H.chain_work(mats)) == 10 and len(kept) == 12


def test_author_search_makes_its_inputs_once(spark, monkeypatch):
    """Both factors and the product are written before they are read again; the rows are the SQL's."""
    d, kept = "/root/testdata/sf0.001", []
    monkeypatch.setattr(catalogue, "materialize", lambda df: kept.append(tuple(df.columns)) or materialize(df))
    got = sorted(map(tuple, catalogue.queries()["hin_author_search"](spark, d).collect()))
    assert kept == [("i", "j", "v")] * 3
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == sorted(c.execute(catalogue.oracle_sql()["hin_author_search"]).fetchall()) and got

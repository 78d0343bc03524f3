"""Findings of round 4, second pass."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from knotwork.matrix import SparseMatrix
from knotwork.operators import grid as R
from knotwork.operators import product as P
from knotwork.plans import queries as catalogue


def test_places_of_rows_that_are_alike_come_in_tiles(spark, monkeypatch):
    """Rows that are alike meet few columns at a time, each the same ones in the same order, and
    no stage of generated code holds a tile."""
    for name, n in (("WIDTH", 8), ("TASK", 256)):
        monkeypatch.setattr(P, name, n, raising=False)
    rows = [(i, k, 1.0 + k) for i in range(64) for k in range(3)] + [(i, 3, 2.0) for i in range(64, 70)]
    a = SparseMatrix.from_entries(spark, rows, 70, 4)
    got = P.salted_spgemm(a, a.transpose(), salts=2, hot=0.1).df
    parts = [[(r["i"], r["j"], r["v"]) for r in p] for p in got.rdd.glom().collect()]
    want = sorted([(i, j, 14.0) for i in range(64) for j in range(64)] + [(i, j, 4.0) for i in range(64, 70) for j in range(64, 70)])
    assert sorted(x for p in parts for x in p) == want
    runs = [tuple(x[1] for x in g) for p in parts for _, g in groupby(p, key=lambda x: x[0])]
    assert max(map(len, runs)) < 40 and len(set(runs)) < 20
    assert "Coalesce " in got._jdf.queryExecution().executedPlan().toString()


def test_lines_are_added_up_in_the_given_number_of_tasks(spark):
    """Adaptive execution doesn't merge the tasks that add up a supplier's lines of a part."""
    m = catalogue.sp(spark, "/root/testdata/sf0.01")
    assert m.df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert "AQEShuffleRead" not in m.df._jdf.queryExecution().executedPlan().toString()
    places = m.df.select("i", "j").collect()
    assert len(places) == len(set(places)) == spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().count()


def test_search_of_sets_makes_no_row_for_a_pair(spark, monkeypatch):
    """Counts, ties to the smaller id and cells are those of the search over products."""
    rng = random.Random(6)
    rows = sorted({(i, rng.randrange(12)) for i in range(60) for _ in range(rng.randrange(1, 7))} | {(i, 0) for i in range(0, 60, 3)} | {(60, 99)})
    a = SparseMatrix.from_entries(spark, rows, 61, 100)
    queries, names = spark.range(0, 80, 4), spark.range(61).select("id", F.concat(F.lit("n"), "id").alias("name"))
    key = lambda df: sorted(map(tuple, df.collect()))
    for k in (1, 4, 100):
        want = key(R.pathsim_search(a, queries, k, names))
        assert key(R.overlap_search(a, queries, k, names)) == want
        with monkeypatch.context() as m:
            m.setattr(R, "BLOCK", 20)
            assert key(R.overlap_search(a, queries, k, names)) == want
    none = SparseMatrix.from_entries(spark, [(1, 1)], 2, 2)
    assert key(R.overlap_search(none, spark.range(0), 3)) == []
    plan = catalogue.queries()["hin_paper_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan

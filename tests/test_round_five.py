"""Findings of round 4."""

import os
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from knotwork.matrix import SparseMatrix
from knotwork.operators import grid as R
from knotwork.operators import metapath as H
from knotwork.operators import product as P
from knotwork.operators import stats as S
from knotwork.plans import queries as catalogue
from knotwork.sources import files

D = "/root/testdata/sf0.001"


def test_doc_term_edges_are_returned_whole(spark):
    got = catalogue.queries()["doc_term_edges"](spark, D)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = c.execute(catalogue.oracle_sql()["doc_term_edges"]).fetchall()
    assert got.columns == ["doc_id", "term_id"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > got.select("doc_id").distinct().count()


def _brute(rows, mul, add):
    by = {}
    for i, k, x in rows:
        for j, k2, y in rows:
            if k == k2:
                by.setdefault((i, j), []).append(mul(x, y))
    return sorted((i, j, float(add(v))) for (i, j), v in by.items())


def test_products_are_made_in_blocks_of_rows(spark, monkeypatch):
    """Many blocks, a heavy row that is split over columns and an inner id whose list is cut
    give the same places, and no place is shuffled."""
    rng = random.Random(4)
    rows = sorted({(rng.randrange(40), rng.randrange(15)) for _ in range(140)} | {(7, k) for k in range(15)} | {(i, 3) for i in range(40)})
    rows = [(i, k, float(1 + (i * 5 + k) % 7)) for i, k in rows]
    a = SparseMatrix.from_entries(spark, rows, 40, 15)
    for name, n in (("SHARE", 40), ("LEAST", 10), ("CHUNK", 6)):
        monkeypatch.setattr(P, name, n)
    key = lambda m: sorted(map(tuple, m.df.collect()))
    blocks = P.row_blocks(*P.sides(a, a.transpose()))
    assert len(blocks.firsts) > 8 and max(blocks.pieces) > 1 and blocks.longest > 6
    for mul, add, total in ((P.times, F.sum, sum), (P.plus, F.min, min)):
        want = _brute(rows, lambda x, y, m=mul: m(x, y), total)
        for product in (P.spgemm, R.grid_spgemm, R.balanced_spgemm):
            assert key(product(a, a.transpose(), mul=mul, add=add)) == want
        assert key(P.gram(a, mul=mul, add=add)) == want == key(R.grid_gram(a, mul=mul, add=add))
        assert key(R.grid_gram(a, True, mul=mul, add=add)) == [x for x in want if x[0] <= x[1]]
    for hint in ("broadcast", "shuffle_hash", "merge"):
        assert key(P.spgemm(a, a.transpose(), hint=hint)) == _brute(rows, lambda x, y: x * y, sum)
    places = [x[:2] for x in want]
    assert sorted(map(tuple, P.join_project(a, a.transpose()).collect())) == places
    assert sorted((r["i"], r["j"]) for r in R.grid_project(a, a.transpose()).collect()) == places
    assert {r["i"]: r["nnz"] for r in S.nnz_per_row_sketch(a, a.transpose()).collect()} == Counter(i for i, _ in places)
    for df in (P.spgemm(a, a.transpose()).df, P.join_project(a, a.transpose()), R.grid_gram(a).df, S.nnz_per_row_sketch(a, a.transpose())):
        assert "hashpartitioning(i" not in df._jdf.queryExecution().executedPlan().toString()


def test_paths_in_steps_and_without_the_guard(spark, monkeypatch):
    """The registered path is multiplied whatever its steps take."""
    monkeypatch.setattr(H, "guard_flop", lambda a, b, most: (_ for _ in ()).throw(ValueError("refused")))
    got = {r["i"]: (r["nnz"], r["total"]) for r in catalogue.queries()["metapath_cheapest"](spark, D).collect()}
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    assert got == {i: (n, v) for i, n, v in c.execute(catalogue.oracle_sql()["metapath_cheapest"]).fetchall()}


def test_arcs_are_written_by_several_tasks(spark, tmp_path):
    """The p line comes first and arcs follow in order, dealt over partitions."""
    a = SparseMatrix.from_entries(spark, [(i, (i * 7) % 50, 1.0 + i % 3) for i in range(50)], 50, 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files.write_dimacs(a, str(tmp_path / "g"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(p for p in os.listdir(tmp_path / "g") if p.startswith("part-"))
    lines = [open(tmp_path / "g" / p).read().splitlines() for p in parts]
    whole = [x for p in lines for x in p]
    assert whole == ["p sp 50 50", *(f"a {i + 1} {(i * 7) % 50 + 1} {1 + i % 3}" for i in range(50))]
    assert sum(len(p) > 0 for p in lines) > 2
    assert sorted(map(tuple, files.read_dimacs(spark, str(tmp_path / "g")).df.collect())) == sorted(map(tuple, a.df.collect()))

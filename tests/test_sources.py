"""Readers, writers, generators and exact values of the skew statistics."""

import numpy as np
import pytest

from knotwork.matrix import SparseMatrix, same
from knotwork.functions import text as T
from knotwork.operators import graph as G
from knotwork.operators import layout as L
from knotwork.operators import metapath as H
from knotwork.operators import product as P
from knotwork.operators import stats as S
from knotwork.sources import files, generators, hin, mtx
from knotwork.streaming import cooccurrence


def entries(m):
    return sorted((r["i"], r["j"], r["v"]) for r in m.df.collect())


@pytest.mark.parametrize("step", [3, 7, 1000])
def test_mtx_edges(spark, tmp_path, step):
    p = str(tmp_path / "a.mtx")
    with open(p, "w") as f:
        f.write("%%MatrixMarket matrix coordinate real general\n% note\n3 4 7\n1 1 0.5\n3 3 5\n2 2\n1 2 0.0\n1 1 2.5\n3 4 1e3\n1 4 -2")
    m = mtx.read_mtx(spark, p, range_bytes=step)
    assert (m.n_rows, m.n_cols) == (3, 4)
    assert entries(m) == [(0, 0, 0.5), (0, 0, 2.5), (0, 3, -2.0), (1, 1, 1.0), (2, 2, 5.0), (2, 3, 1000.0)]
    assert {v for *_, v in entries(mtx.read_mtx(spark, p, "ones"))} == {1.0}


def test_mtx_symmetric_and_round_trips(spark, tmp_path):
    p = str(tmp_path / "s.mtx")
    with open(p, "w") as f:
        f.write("%%MatrixMarket matrix coordinate real symmetric\n3 3 3\n1 1 4\n2 1 5\n3 2 6\n")
    m = mtx.read_mtx(spark, p)
    assert len(entries(m)) == 5
    q, b = str(tmp_path / "q.mtx"), str(tmp_path / "b.bin")
    mtx.write_mtx(m, q, symmetric=True)
    assert entries(mtx.read_mtx(spark, q)) == entries(m) and same(m.df, mtx.read_mtx(spark, q).df).isEmpty()
    mtx.write_bin(m, b)
    assert entries(mtx.read_bin(spark, b, 48)) == entries(m)


def test_edges_and_generators(spark, tmp_path):
    g = generators.rmat(spark, 6, 200, "g500", seed=3)
    assert g.df.count() == 200 == g.df.select("i", "j").distinct().count() and g.df.where("i = j").isEmpty()
    assert entries(g) == entries(generators.rmat(spark, 6, 200, "g500", seed=3))
    p = str(tmp_path / "g500_6_3.txt")
    files.write_edges(g, p)
    assert files.read_edges(spark, p).n_rows == 64 and files.read_edges(spark, p).df.count() == 400
    assert abs(generators.gnp(spark, 300, 0.05, 1).df.count() / (300 * 300 * 0.05) - 1) < 0.1


@pytest.mark.parametrize("values,want", [([10] + [1] * 10, 2), ([10] + [1] * 9, 1), ([1] * 1000, 501), ([1000] + [0] * 999, 1), ([], None), ([0, 0, 0], None)])
def test_crossover(spark, values, want):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "i long, flop long")
    r = S.concentration(df).first()
    assert (r["crossover"] if r else None) == want
    if values == [1] * 1000:
        assert r["gini"] == pytest.approx(0)
    if values[:1] == [1000]:
        assert r["gini"] > 0.998


def test_analyse_self_test(spark):
    """Exact values for small inputs, and zeros where there is nothing."""

    def run(values, **options):
        return S.analyse(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "i long, flop long"), **options).first().asDict()

    r = run([10] + [1] * 10, heads=(0.1,), masses=(0.5, 1.0))
    assert r["crossover_k"] == 2 and r["top10pct_share"] == pytest.approx(0.5) and r["rows_for_50pct"] == pytest.approx(1 / 11) and r["rows_for_100pct"] == pytest.approx(1)
    assert r["crossover_row_frac"] == pytest.approx(2 / 11) and r["crossover_mass_frac"] == pytest.approx(11 / 20)
    r = run([500] + [500 // 99] * 99, threads=10)
    assert r["hot_row_vs_thread"] > 1
    assert run([1] * 1000, threads=10)["hot_row_vs_thread"] < 0.02
    for nothing in ([], [0, 0, 0]):
        r = run(nothing)
        assert r["n"] == len(nothing) and r["alpha"] is None
        assert not any(r[k] for k in ("sum", "gini", "crossover_k", "top10pct_share", "rows_for_50pct", "rows_for_one_thread", "hot_row_vs_thread", "crossover_mass_frac"))


def fitted(x, least_tail=50, most=200):
    """The power-law fit straight from its definition, over the sorted tail."""
    x = np.asarray(x, dtype=float)
    cand = np.unique(x[x > 0])
    if len(cand) > most:
        cand = np.unique(np.percentile(cand, np.linspace(0, 95, most)))
    best = None
    for xmin in cand[cand >= 1]:
        tail = np.sort(x[x >= xmin])
        logs = np.log(tail / (xmin - 0.5)).sum()
        if len(tail) < least_tail or logs <= 0:
            continue
        alpha = 1 + len(tail) / logs
        ks = np.abs(np.arange(1, len(tail) + 1) / len(tail) - (1 - (tail / xmin) ** (1 - alpha))).max()
        if alpha > 1 and (best is None or ks < best["ks"]):
            best = {"alpha": alpha, "xmin": xmin, "ks": ks, "tail": len(tail)}
    return best


def test_row_flop_and_power_law(spark):
    a = SparseMatrix.from_entries(spark, [(0, 0), (0, 1), (1, 2)], 2, 3)
    b = SparseMatrix.from_entries(spark, [(0, 0), (1, 1), (1, 0), (2, 1)], 3, 2)
    assert sorted(map(tuple, S.flop_per_row(a, b).collect())) == [(0, 3), (1, 1)]
    rng = np.random.default_rng(12345)
    pareto = np.floor((rng.pareto(1.5, 20000) + 1) * 10).astype(int)
    for x in (pareto, np.arange(60), np.r_[np.zeros(20), np.full(70, 3)], np.arange(10)):
        got, want = S.powerlaw_fit(spark.createDataFrame([(int(v),) for v in x], "flop long")), fitted(x)
        assert (got is None) == (want is None)
        assert want is None or got == pytest.approx(want)
    assert fitted(pareto)["alpha"] == pytest.approx(2.5, abs=0.35)


def test_work_of_a_path_and_the_guard(spark):
    a = SparseMatrix.from_entries(spark, [(0, 0), (0, 1), (1, 1)], 2, 2)
    b = SparseMatrix.from_entries(spark, [(0, 0), (1, 0), (1, 1)], 2, 2)
    g = H.TypedGraph({("A", "P"): a, ("P", "C"): lambda: b})
    assert [sorted(map(tuple, w.collect())) for w in H.step_work(g, "APCPA")] == [[(0, 3), (1, 2)]]
    assert entries(H.metapath_product(g, "APC")) == [(0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)]
    with pytest.raises(ValueError):
        H.metapath_product(g, "APC", most=4)


def test_rows_out_of_order_are_found(spark):
    m = SparseMatrix.from_entries(spark, [(k % 3, j) for k, j in enumerate(range(60))], 3, 60)
    shuffled = m.shuffle_ids(1)
    assert SparseMatrix.unsorted(m.to_csr()).isEmpty() and SparseMatrix.unsorted(shuffled).count() == 3
    assert sorted((r["i"], e["j"]) for r in shuffled.collect() for e in r["entries"]) == sorted((i, j) for i, j, _ in entries(m))


def test_triangles_of_a_star(spark):
    """Two hundred edges into one vertex are no wedge when hubs come last."""
    star = SparseMatrix.from_entries(spark, [(k, 0) for k in range(1, 200)] + [(1, 2), (5, 6)], 200, 200)
    assert G.triangle_count(star).first()[0] == 2
    n = G.pointed(star, "both").groupBy("low").count()
    assert n.selectExpr("sum(count * (count - 1) div 2)").first()[0] == 2


def test_semirings_of_all_products(spark):
    import pyspark.sql.functions as F

    a = SparseMatrix.from_entries(spark, [(0, 0, 1), (0, 1, 5), (1, 1, 2), (2, 0, 4), (2, 1, 1)], 3, 2)
    t = a.transpose()
    want = entries(P.spgemm(a, t, P.plus, F.min))
    assert entries(P.salted_spgemm(a, t, hot=0.1, mul=P.plus, add=F.min)) == want == entries(P.gram(a, mul=P.plus, add=F.min))
    mask = SparseMatrix.from_entries(spark, [(0, 1), (2, 2), (2, 2)], 3, 3)
    assert entries(P.masked_product(a, t, mask, P.plus, F.min)) == [x for x in want if x[:2] in ((0, 1), (2, 2))]


def test_thresholds_ranges_and_small_helpers(spark):
    import pyspark.sql.functions as F

    df = spark.createDataFrame([(k, k * k) for k in range(20)], "i long, x long")
    at = {r["t"]: r["at"] for r in L.lower_bound(df, "i", "x", spark.createDataFrame([(0,), (5,), (361,), (400,)], "t long")).collect()}
    assert at == {0: 0, 5: 3, 361: 19, 400: None}
    halves = spark.createDataFrame([(k, 0.5) for k in range(10)], "i long, w double")
    assert [r["part"] for r in L.balanced_ranges(halves, 2, "w").orderBy("i").collect()] == [0] * 6 + [1] * 4
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (5,), (8,), (9,)], "x long").select(L.next_pow2(F.col("x"))).collect()] == [1, 1, 8, 8, 16]
    assert [r["x"] for r in L.ordered(df, "x", descending=True).limit(2).collect()] == [361, 324]
    hist = spark.createDataFrame([(x, 1) for x in (0, 1, 2, 3, 1000, 1001, 5)], "x long, n long")
    assert {r["x"]: r["b"] for r in L.magnitude_scan(hist, "x", True, b=F.col("n")).collect()} == {0: 6, 1: 5, 2: 4, 3: 3, 5: 2, 1000: 1, 1001: 0}
    parts = spark.createDataFrame([(0, 4, 2, 1), (0, 2, 1, 1), (1, 0, 0, 0)], "part long, flop long, nnz_in long, nnz_out long")
    assert sorted((r["part"], r["cfi"], r["cfo"]) for r in S.part_factors(parts).collect()) == [(0, 2.0, 3.0), (1, 0.0, 0.0)]


def test_other_formats(spark, tmp_path):
    m = SparseMatrix.from_entries(spark, [(0, 1, 2), (1, 0, 3), (0, 1, 5)], 2, 2)
    p = str(tmp_path / "c.bin")
    with open(p, "wb") as f:
        f.write(np.array([2, 2, 3], "<i8").tobytes() + np.array([0, 1, 0, 1, 0, 1], "<i8").tobytes() + np.array([2.0, 3.0, 5.0]).tobytes())
    assert entries(mtx.read_columns(spark, p, 24)) == entries(m)
    q = str(tmp_path / "d.mtx")
    mtx.write_mtx(m, q, dedup=True)
    assert entries(mtx.read_mtx(spark, q)) == [(0, 1, 2.0), (1, 0, 3.0)]
    mtx.write_mtx(m, q, "none")
    assert {v for *_, v in entries(mtx.read_mtx(spark, q))} == {1.0}
    with open(q, "w") as f:
        f.write("2 2 1\n1 2 7\n")
    assert entries(mtx.read_mtx(spark, q, unless_general=True)) == [(0, 1, 7.0), (1, 0, 7.0)]
    files.write_dimacs(m, str(tmp_path / "gr"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "gr")).collect()]
    assert "p sp 2 3" in lines and "a 2 1 3" in lines and len(lines) == 4
    with open(tmp_path / "gr" / "part-more.txt", "w") as f:
        f.write("c a comment of some words\nc\n")
    back = files.read_dimacs(spark, str(tmp_path / "gr"))
    assert entries(back) == entries(m) and back.n_rows == 2
    (tmp_path / "headless.gr").write_text("a 1 2 3\n")
    with pytest.raises(ValueError):
        files.read_dimacs(spark, str(tmp_path / "headless.gr"))
    files.write_sorted_csv(m, str(tmp_path / "csv"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()) == sorted(["2,2,3", "1,2,2.0", "1,2,5.0", "2,1,3.0"])
    (tmp_path / "r.csv").write_text("u,i,r,x\na,b,3,9\n")
    assert files.read_ratings(spark, str(tmp_path / "r.csv")).collect()[0].asDict() == {"user": "a", "item": "b", "rating": "3"}
    (tmp_path / "x.txt").write_text("\x1b[31mtime: 3.5\x1b[0m\nnothing\nname: a: b\n\n")
    assert files.count_lines(spark, str(tmp_path / "x.txt")) == 3
    assert {tuple(r) for r in T.parse_log(spark.read.text(str(tmp_path / "x.txt"))).collect()} == {("time", "3.5"), ("name", "a: b")}


def test_titles_and_principals(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write("tconst\ttitleType\tx\ntt0000001\tmovie\t\ntt0000002\tshort\t\n")
    with gzip.open(tmp_path / "p.tsv.gz", "wt") as f:
        f.write("tconst\tordering\tnconst\tcategory\ntt0000001\t1\tnm0000007\tactor\ntt0000001\t2\tnm0000008\teditor\ntt0000002\t1\tnm0000007\tactor\n")
    titles = files.read_title_types(spark, str(tmp_path / "b.tsv.gz"), ["movie"])
    got = files.read_principals(spark, str(tmp_path / "p.tsv.gz"), ["actor"], titles)
    assert [tuple(r) for r in got.collect()] == [(1, 7)]
    assert files.read_principals(spark, str(tmp_path / "p.tsv.gz")).count() == 3


def test_publications(spark, tmp_path):
    rows = [
        '{"id": "x1", "title": "Graph mining at scale", "authors": ["Ann\\tB", "Bo", "Bo", ""], "venue": "V1"}', "", "not json",
        '{"id": "x2", "title": "Mining of graph data", "authors": ["Bo"], "venue": "V2"}', '{"id": "x3", "title": null, "authors": null, "venue": ""}',
        '{"id": "x4", "title": "Data at scale", "authors": ["Cy", "Bo"], "venue": "V1"}',
    ]
    (tmp_path / "in.json").write_text("\n".join(rows))
    p = hin.from_json(spark, str(tmp_path / "in.json"))
    hin.write(p, str(tmp_path / "out"))
    p = hin.read(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, p.authors.collect())) == [(1, "Ann B"), (2, "Bo"), (3, "Cy")]
    assert sorted(map(tuple, p.terms.collect())) == [(1, "data"), (2, "graph"), (3, "mining"), (4, "scale")]
    assert sorted(map(tuple, p.ap.collect())) == [(1, 1), (2, 1), (2, 2), (2, 4), (3, 4)] and sorted(map(tuple, p.cp.collect())) == [(1, 1), (1, 4), (2, 2)]
    assert sorted(map(tuple, p.pt.collect())) == [(1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (4, 1), (4, 4)] and p.papers.count() == 4
    matrices, names, meta = hin.subset(p, ["V1"], 1, None, 2)
    assert meta["nodes"] == {"A": 3, "P": 2, "C": 1, "T": 1} and meta["edges"] == {"ap": 4, "cp": 2, "pt": 2}
    assert sorted(map(tuple, names["A"].collect())) == [(1, "Ann B"), (2, "Bo"), (3, "Cy")] and names["T"].first()["name"] == "scale"
    hin.write_subset(matrices, names, meta, str(tmp_path / "sub"))
    org, trs = mtx.read_mtx(spark, str(tmp_path / "sub/ap.org.mtx")), mtx.read_mtx(spark, str(tmp_path / "sub/ap.trs.mtx"))
    assert entries(org) == entries(matrices["ap"]) == entries(trs.transpose())
    assert sorted(map(tuple, files.read_names(spark, str(tmp_path / "sub/C.names.tsv")).collect())) == [(1, "V1")]
    for kind in ("json", "csv", "md"):
        hin.write_report([{"a": 1}, {"a": 2, "b": 3}], str(tmp_path / f"r.{kind}"))
    assert (tmp_path / "r.csv").read_text() == "a,b\n1,\n2,3\n" and (tmp_path / "r.md").read_text().startswith("|a|b|\n|---|---|\n|1||")
    got = [tuple(r) for r in files.split_json(spark, str(tmp_path / "in.json"), ["id", "venue"]).collect()]
    assert got == [("x1", "V1"), (None, None), ("x2", "V2"), ("x3", None), ("x4", "V1")]


def test_generators_again(spark):
    for options in ({"joint": True}, {"undirected": True}, {"self_loops": True, "duplicates": True}):
        g = generators.rmat(spark, 6, 150, (0.45, 0.22, 0.22), seed=2, **options)
        assert entries(g) == entries(generators.rmat(spark, 6, 150, (0.45, 0.22, 0.22), seed=2, **options)) and g.df.count() == 150
    # quadrants drawn at equal odds stay even over all levels, whatever the noise
    flat = generators.rmat(spark, 10, 20_000, (0.25, 0.25, 0.25), seed=5, joint=True, duplicates=True)
    assert abs(flat.df.selectExpr("avg(i)").first()[0] / 512 - 1) < 0.06
    w = [v for *_, v in entries(generators.weights(flat, 2.0, 3.0))]
    assert 2.0 <= min(w) and max(w) < 3.0 and abs(np.mean(w) - 2.5) < 0.02
    n = generators.gnp(spark, 200, 0.1, 4).df
    assert n.count() == n.distinct().count() and n.agg({"j": "max"}).first()[0] < 200
    s = generators.ssca2(spark, 7, seed=3)
    assert entries(s) == entries(generators.ssca2(spark, 7, seed=3)) and s.out_of_range().isEmpty() and s.df.where("i = j").isEmpty()


def test_stream_of_pairs(spark, tmp_path):
    """Windows of a stream give the same pairs as the whole table does at once."""
    rows = [(f"2024-01-01 00:{m:02d}:00", u, t) for m, u, t in ((0, 1, "a"), (5, 2, "a"), (6, 1, "a"), (59, 3, "b"), (61 % 60, 2, "b"))] + [("2024-01-01 03:00:00", 9, "z")]
    events = spark.createDataFrame(rows, "ts string, user_id long, event_type string").selectExpr("cast(ts as timestamp) as ts", "user_id", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = cooccurrence.windowed_counts(stream).writeStream.outputMode("append").foreachBatch(cooccurrence.add_batch(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["i"], r["j"]): r["v"] for r in spark.read.parquet(out).where("i < 9").groupBy("i", "j").agg({"v": "sum"}).withColumnRenamed("sum(v)", "v").collect()}
    assert got == {(1, 1): 4, (1, 2): 2, (2, 2): 2, (3, 3): 1, (2, 3): 1}


def test_samples(spark):
    df = spark.createDataFrame([(u % 30, u) for u in range(200)], "user long, x long")
    got = T.sample_uniform(df, "user", 7)
    assert got.select("user").distinct().count() == 7 and sorted(map(tuple, got.collect())) == sorted(map(tuple, T.sample_uniform(df.repartition(5), "user", 7).collect()))
    users = {r[0] for r in got.collect()}
    assert got.count() == sum(u % 30 in users for u in range(200))
    assert {r[0] for r in T.sample_top(df, "user", 3).collect()} == {0, 1, 2}


def test_a_right_side_too_large_to_broadcast(spark, monkeypatch):
    """The product is made whole by a partitioned join instead of being refused."""
    a = SparseMatrix.from_entries(spark, [(0, 0, 1), (0, 1, 5), (1, 1, 2), (2, 0, 4), (2, 1, 1)], 3, 2)
    want = entries(P.spgemm(a, a.transpose()))
    assert entries(P.join_aggregate(a, a.transpose(), partitioned=False)) == want
    monkeypatch.setattr(P, "SMALL", 4)
    assert entries(P.join_aggregate(a, a.transpose(), partitioned=False)) == want


def test_salted_product_of_rows_that_are_alike(spark, monkeypatch):
    """Rows with the same entries are multiplied once and stand for all of them, whatever
    the semiring; entries that repeat, without value or id included."""
    import pyspark.sql.functions as F

    rows = [(i, j, float(1 + j)) for i in range(30) for j in range(1 + i % 3)] + [(40, 5, None), (41, 5, None), (42, 5, 2.0), (43, 5, 2.0), (None, 0, 1.0), (44, None, 1.0), (45, 0, 1.0), (45, 0, 1.0)]
    a = SparseMatrix(spark.createDataFrame(rows, "i long, j long, v double"), 50, 50)
    key = lambda m: sorted(((r["i"], r["j"], r["v"]) for r in m.df.collect()), key=repr)
    for mul, add in ((P.times, F.sum), (P.plus, F.min)):
        want = key(P.spgemm(a, a.transpose(), mul, add))
        assert key(P.salted_spgemm(a, a.transpose(), salts=3, hot=0.1, mul=mul, add=add)) == want
    made = []
    salted = P._salted
    monkeypatch.setattr(P, "_salted", lambda x, y, *rest: made.append(x.select("i").distinct().count()) or salted(x, y, *rest))
    assert key(P.salted_spgemm(a, a.transpose())) == key(P.spgemm(a, a.transpose())) and made == [6]
    apart = SparseMatrix.from_entries(spark, [(i, j) for i in range(6) for j in range(i + 1)], 6, 6)
    assert entries(P.salted_spgemm(apart, apart.transpose())) == entries(P.spgemm(apart, apart.transpose()))
    none = SparseMatrix.from_entries(spark, [], 3, 3)
    assert entries(P.salted_spgemm(none, none)) == []

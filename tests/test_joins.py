"""Products over grids, similarity joins, searches and sketches against brute force."""

import random
from itertools import combinations
from statistics import median

from pyspark.sql import functions as F

from knotwork.matrix import SparseMatrix
from knotwork.operators import graph as G
from knotwork.operators import grid as R
from knotwork.operators import layout as L
from knotwork.operators import metapath as H
from knotwork.operators import product as P
from knotwork.operators import similarity as J
from knotwork.operators import stats as S
from knotwork.sources import mtx, store


def test_triangles_and_masked_edges_by_colours(spark):
    """Counts don't depend on how many colours deal the edges; repeats, both
    directions and a diagonal included."""
    rng = random.Random(7)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(250)} | {(0, k) for k in range(1, 40)})
    a = SparseMatrix.from_entries(spark, [*edges, *((j, i) for i, j in edges[:50]), (3, 3), *edges[:9]], 40, 40)
    known = set(edges)
    want = sum((x, y) in known and (y, z) in known and (x, z) in known for x, y, z in combinations(range(40), 3))
    hit = {(x, y) for x, y in known if any((k, x) in known and (k, y) in known for k in range(x))}
    for colours in (1, 2, 3, 5):
        assert G.triangle_count(a, colours).first()["triangles"] == want
        assert G.masked_edge_count(a, order=False, colours=colours).first()["l"] == len(hit)
    none = SparseMatrix.from_entries(spark, [(1, 1)], 3, 3)
    assert G.triangle_count(none).first()[0] == 0 == G.masked_edge_count(none).first()["l"]
    far = 1 << 40
    a = SparseMatrix.from_entries(spark, [(i * far, j * far) for i, j in edges], 40 * far, 40 * far)
    assert G.triangle_count(a).first()["triangles"] == want


def test_blocks_of_colours():
    """Sorted triples are numbered without gaps, and there are as many as asked for."""
    assert [G.colours_for(n) for n in (1, 2, 4, 5, 10, 11, 200)] == [1, 2, 2, 3, 3, 4, 10]


def test_lists_meet_without_shuffling_wedges(spark):
    """After the lists are dealt to the blocks there is no exchange but that of the counts,
    and a hub's edges point to it."""
    hub = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(1, 199)]
    a = SparseMatrix.from_entries(spark, hub, 200, 200)
    assert G.triangle_count(a).first()["triangles"] == 198
    low = G.pointed(a, "both").groupBy("low").agg(F.count("*").alias("n"))
    assert low.agg(F.max("n")).first()[0] <= 3
    plan = G.triangle_count(a)._jdf.queryExecution().executedPlan().toString()
    by_block = plan[: plan.index("REPARTITION_BY_NUM")]
    assert by_block.count("Exchange") == 2 and "SinglePartition" in by_block
    # the lists are dealt once and used three times
    counted = G.triangle_count(a)
    counted.collect()
    final = counted._jdf.queryExecution().executedPlan().toString()
    final = final[final.index("Final Plan") : final.index("Initial Plan")]
    assert final.count("ReusedExchange") >= 2


def test_all_pairs_by_cells(spark):
    """The best of all pairs against the product, whatever the grid; ids far apart,
    repeats and nulls."""
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 2, 5, 9, 1 << 40]), rng.randrange(8), float(rng.randint(1, 5))) for _ in range(60)]
    rows += [(7, 100, None), (8, 100, 2.0), (8, None, 3.0), (9, 3, None), (None, 3, 1.0)]
    a = SparseMatrix(spark.createDataFrame(rows, "i long, j long, v double"), 1 << 41, 200)
    d, dot = {}, {}
    for i, j, v in rows:
        if i is not None:
            d[i] = d.get(i, 0) + (v or 0) ** 2
            for i2, j2, v2 in rows:
                if i2 is not None and i != i2 and j is not None and j == j2:
                    dot.setdefault(i, {}).setdefault(i2, []).append(None if v is None or v2 is None else v * v2)
    want = []
    for i, others in dot.items():
        score = {j: 2 * sum(got) / (d[i] + d[j]) if (got := [x for x in p if x is not None]) else None for j, p in others.items()}
        want += [(i, j, score[j] and round(score[j], 9)) for j in sorted(score, key=lambda j: (score[j] is None, -(score[j] or 0), j))[:3]]
    for blocks in (1, 3, 6):
        got = R.pathsim_all(a, 3, blocks).collect()
        assert sorted((r["i"], r["j"], r["score"] and round(r["score"], 9)) for r in got) == sorted(want)
    assert R.pathsim_all(SparseMatrix.from_entries(spark, [], 3, 3), 3).collect() == []


def test_cells_that_the_bound_skips(spark):
    """Where norms differ widely most cells are skipped, and nothing is lost."""
    rng = random.Random(11)
    rows = [(i, j, float(4 ** (i // 12))) for i in range(96) for j in rng.sample(range(6), 4)]
    a = SparseMatrix.from_entries(spark, rows, 96, 6)
    got, made, cells = R._pathsim_cells(a, 3, 8)
    m = {}
    for i, j, v in rows:
        m.setdefault(i, {})[j] = v
    norm = {i: sum(v * v for v in x.values()) for i, x in m.items()}
    want = set()
    for i in m:
        score = {y: 2 * sum(v * m[y].get(j, 0) for j, v in m[i].items()) / (norm[i] + norm[y]) for y in m if y != i and m[i].keys() & m[y].keys()}
        want |= {(i, y, round(score[y], 9)) for y in sorted(score, key=lambda y: (-score[y], y))[:3]}
    assert {(r["i"], r["j"], round(r["score"], 9)) for r in got.collect()} == want
    assert cells >= 28 and made < cells / 2


def test_search_of_many(spark):
    a = SparseMatrix.from_entries(spark, [(0, 0), (0, 1), (1, 0), (1, 1), (2, 1), (3, 2), (40, 1), (40, 2, 3)], 41, 3)
    queries = spark.createDataFrame([(0,), (40,), (40,), (7,), (None,)], "id long")
    names = spark.createDataFrame([(k, f"n{k}") for k in (0, 1, 3, 40)], "id long, name string")
    got = {(r["query"], r["place"], r["id"], r["name"], round(r["score"], 6)) for r in R.pathsim_search(a, queries, 3, names).collect()}
    assert got == {(0, 1, 0, "n0", 1.0), (0, 2, 1, "n1", 1.0), (0, 3, 2, None, round(2 / 3, 6)), (40, 1, 40, "n40", 1.0), (40, 2, 3, "n3", round(6 / 11, 6)), (40, 3, 2, None, round(2 / 11, 6))}
    for q in (0, 40):
        one = [(r["id"], round(r["score"], 6)) for r in H.pathsim_topk(a, q, 3).collect()]
        assert one == [(i, v) for _, _, i, _, v in sorted(x for x in got if x[0] == q)]


def test_grid_products_have_no_third_exchange(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(9), rng.randrange(30), float(rng.randint(1, 5))) for _ in range(150)] + [(3, k, 1.0) for k in range(30)]
    a = SparseMatrix.from_entries(spark, rows, 9, 30)
    key = lambda m: sorted(map(tuple, m.df.collect()))
    for mul, add in ((P.times, F.sum), (P.plus, F.min)):
        want = key(P.spgemm(a, a.transpose(), mul, add))
        for product in (R.grid_spgemm, R.balanced_spgemm):
            assert key(product(a, a.transpose(), mul=mul, add=add)) == want
            assert key(product(a, a.transpose(), 1, 5, mul, add)) == want == key(product(a, a.transpose(), 3, 1, mul, add))
    plan = R.grid_spgemm(a, a.transpose()).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2
    none = SparseMatrix.from_entries(spark, [], 3, 3)
    assert key(R.grid_spgemm(none, none)) == [] == key(R.balanced_spgemm(none, none))


def test_cells_of_equal_work(spark):
    """A row that has a fifth of the work, and a column like it: no cell has more
    than twice the median's."""
    rows = [(i, (i * 7 + k * 13) % 400) for i in range(400) for k in range(6)] + [(5, k) for k in range(400)] + [(i, 9) for i in range(300)]
    a = SparseMatrix.from_entries(spark, sorted(set(rows)), 400, 400)
    work = {r["cell"]: r["flop"] for r in R.cell_work(a, a.transpose(), 4, 4).collect()}
    assert sum(work.values()) == P.flop_total(a, a.transpose()) and len(work) == 16
    assert max(work.values()) <= 2 * median(work.values())


def test_sizes_by_sketches(spark):
    """Estimates are within four standard errors, and exact where rows are short."""
    rng = random.Random(4)
    a = SparseMatrix.from_entries(spark, [(i, rng.randrange(40)) for i in range(60) for _ in range(i % 7)], 60, 40)
    b = SparseMatrix.from_entries(spark, [(k, rng.randrange(50_000)) for k in range(40) for _ in range(k * 30)] + [(3, 1)], 40, 50_000)
    exact = {r["i"]: r["nnz"] for r in S.nnz_per_row(a, b).collect()}
    near = {r["i"]: r["nnz"] for r in S.nnz_per_row_sketch(a, b).collect()}
    assert exact.keys() == near.keys() and max(exact.values()) > 3_000
    assert all(abs(near[i] - n) <= 4 * 1.04 / 64 * n for i, n in exact.items())
    assert all(near[i] == n for i, n in exact.items() if n <= 30)


def test_similarity_by_definition(spark):
    """Pairs and links against all pairs, by either index, with copies, a column that
    all rows have, empty rows and thresholds at which pairs just pass."""
    rng = random.Random(6)
    sets = {i: {0} | {int(rng.paretovariate(0.7)) % 40 for _ in range(rng.randint(0, 9))} for i in range(0, 120, 2)}
    sets |= {i + 1: set(sets[i]) for i in range(0, 40, 4)}
    a = SparseMatrix.from_entries(spark, [(i, j) for i, x in sets.items() for j in [*x, *list(x)[:1]]], 130, 40)
    for overlap, jaccard in ((1, 0.5), (2, None), (2, 0.4), (3, 0.75), (4, None), (1, 1.0)):
        want = {}
        for i, j in combinations(sorted(sets), 2):
            n = len(sets[i] & sets[j])
            share = n / len(sets[i] | sets[j])
            if n >= overlap and (jaccard is None or share >= jaccard):
                want[i, j] = (n, round(share, 9))
        assert {(r["i"], r["j"]): (r["overlap"], round(r["jaccard"], 9)) for r in J.set_similarity(a, overlap, jaccard).collect()} == want
        held, members = J.classes(a)
        for keys in (1, 2) if overlap >= 2 else (1,):
            pairs = {(r["c"], r["d"]): r["overlap"] for r in J.similar_classes(held, overlap, jaccard, keys).collect()}
            first = {i: min(k for k in sets if sets[k] == sets[i]) for i in sets}
            assert pairs == {(i, j): n for (i, j), (n, _) in want.items() if first[i] == i and first[j] == j and sets[i] != sets[j]}
        links = {r["i"]: (r["c"], r["links"]) for r in J.similarity_links(a, overlap, jaccard).collect()}
        assert links == {i: (first[i], sum(i in p for p in want)) for i in sets}
    assert J.set_similarity(SparseMatrix.from_entries(spark, [], 3, 3), 2).collect() == []


def test_a_column_of_all_rows_is_not_expanded(spark):
    """Rows that share one column and nothing else: no candidates are met."""
    a = SparseMatrix.from_entries(spark, [(i, 0) for i in range(3_000)] + [(i, 1 + i) for i in range(3_000)], 3_000, 3_001)
    sets, _ = J.classes(a)
    found = J.similar_classes(sets, 2, None, 1)
    assert found.count() == 0
    # what one column meets stays small where others decide
    met = found._jdf.queryExecution().optimizedPlan().toString()
    assert "met" not in met
    # by the prefix of an overlap of 2, which leaves the last column out
    assert sets.select(F.explode(F.slice("ks", F.lit(1), F.col("n") - 1)).alias("k")).where("k = 0").count() == 0


def test_cheapest_order_of_a_chain(spark):
    """Estimates equal the true multiplications of every part, and the order found is
    the best of all orders."""
    rng = random.Random(13)
    shapes = [30, 4, 25, 3, 40]
    dense = [[(i, j) for i in range(shapes[k]) for j in range(shapes[k + 1]) if rng.random() < 0.4] for k in range(4)]
    mats = [SparseMatrix.from_entries(spark, x, shapes[k], shapes[k + 1]) for k, x in enumerate(dense)]
    work = H.chain_work(mats)

    def pattern(i, j):
        got = set(dense[i])
        for k in range(i + 1, j + 1):
            right = {}
            for a, b in dense[k]:
                right.setdefault(a, []).append(b)
            got = {(a, c) for a, b in got for c in right.get(b, [])}
        return got

    def flop(i, k, j):
        right = {}
        for a, _ in pattern(k + 1, j):
            right[a] = right.get(a, 0) + 1
        return sum(right.get(b, 0) for _, b in pattern(i, k))

    assert {k: round(v) for k, v in work.items()} == {(i, k, j): flop(i, k, j) for i in range(4) for j in range(i + 1, 4) for k in range(i, j)}

    def every(i, j):
        return [0] if i == j else [x + y + flop(i, k, j) for k in range(i, j) for x in every(i, k) for y in every(k + 1, j)]

    cost, cut = H.cheapest_order(4, work)
    assert round(cost) == min(every(0, 3)) < flop(0, 0, 1) + flop(0, 1, 2) + flop(0, 2, 3)
    g = H.TypedGraph({pair: m for pair, m in zip(["AB", "BC", "CD", "DE"], mats, strict=True)})
    g.edges = {tuple(k): v for k, v in g.edges.items()}
    key = lambda m: sorted(map(tuple, m.df.collect()))
    assert key(H.metapath_product(g, "ABCDE", cheapest=True)) == key(H.metapath_product(g, "ABCDE"))


def test_range_search_and_many_thresholds(spark, monkeypatch):
    values = [0, 0, 3, 3, 3, 7, 20, 20, 21]
    scanned = spark.createDataFrame(list(enumerate(values)), "at long, x long")
    asked = [-5, 0, 1, 3, 4, 7, 8, 20, 21, 22, 3, None]
    t = spark.createDataFrame([(x,) for x in asked], "t long")
    for above in (False, True):
        want = {x: next((k for k, v in enumerate(values) if (v > x if above else v >= x)), None) for x in asked if x is not None}
        assert {r["t"]: r["at"] for r in L.range_search(scanned, "at", "x", t, above).collect()} == want
    few = sorted(map(repr, L.lower_bound(scanned, "at", "x", t.where("t is not null")).collect()))
    monkeypatch.setattr(L, "FEW", 3)
    assert sorted(map(repr, L.lower_bound(scanned, "at", "x", t.where("t is not null")).collect())) == few


def test_ten_thousand_blocks_in_few_passes(spark, monkeypatch):
    """Blocks as a walk over the rows makes them; passes are the logarithm of their number."""
    rng = random.Random(3)
    for n, blocks in ((40, 7), (300, 250), (11_000, 10_000)):
        flop = [rng.choice([0, 0, 1, 2, 3, 50]) if n < 1000 else 1 + (k % 3 == 0) for k in range(n)]
        work = spark.createDataFrame(list(enumerate(flop)), "i long, flop long")
        want, block, cur = [], 0, 0
        for k, w in enumerate(flop):
            if k and cur > sum(flop) // blocks:
                block, cur = block + 1, 0
            cur += w
            want.append((k, w, block))
        passes = []
        kept = L.materialize
        monkeypatch.setattr(L, "materialize", lambda df: passes.append(1) or kept(df))
        assert sorted(map(tuple, L.greedy_blocks(work, blocks).select("i", "flop", "block").collect())) == want
        monkeypatch.setattr(L, "materialize", kept)
        assert len(passes) < 2 * 15 + 6
    none = spark.createDataFrame([], "i long, flop long")
    assert L.greedy_blocks(none, 3).collect() == []


def test_stored_products_join_without_exchange(spark, tmp_path):
    rng = random.Random(1)
    a = SparseMatrix.from_entries(spark, [(rng.randrange(20), rng.randrange(9), float(k % 4)) for k in range(90)], 20, 9)
    store.save(a, "stored_test", str(tmp_path), 4)
    held = store.load(spark, "stored_test")
    assert (held.n_rows, held.n_cols) == (20, 9)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(held.matrix.df) == key(a.df) == key(held.transpose().transpose().by_col)
    got = store.stored_spgemm(held, held.transpose())
    assert key(got.df) == key(P.spgemm(a, a.transpose()).df)
    plan = store.stored_spgemm(held, held.transpose()).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange" not in plan[plan.index("SortMergeJoin") :]
    store.remove(spark, "stored_test")


def test_mtx_on_another_file_system(spark, tmp_path):
    """A round trip, a pair, and a plain file with comments and an entry that reads like
    the size line, all through a mounted scheme."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.box.link./data", f"file://{tmp_path}")
    a = SparseMatrix.from_entries(spark, [(0, 1, 2.5), (3, 0, 1.0), (2, 2, -4.0)], 5, 4)
    key = lambda m: sorted(map(tuple, m.df.collect()))
    for path in ("viewfs://box/data/a.mtx", "viewfs://box/data/b.mtx"):
        mtx.write_mtx(a, path, symmetric=path.endswith("b.mtx"))
        got = mtx.read_mtx(spark, path)
        assert (got.n_rows, got.n_cols) == (5, 4)
        assert key(got) == (key(a) if path.endswith("a.mtx") else [(0, 1, 2.5), (1, 0, 2.5), (2, 2, -4.0)])
    mtx.write_mtx(a, "viewfs://box/data/p.org", "ones")
    org, trs = mtx.load_pair(spark, "p", "viewfs://box/data")
    assert key(trs) == sorted((j, i, v) for i, j, v in key(org))
    with open(tmp_path / "plain.mtx", "w") as f:
        f.write("%%MatrixMarket matrix coordinate real general\n" + "% note\n" * 100 + "3 3 5\n3 3 5\n 1 2\n1 1 0\n3 3 5\n2 2 1e1")
    assert key(mtx.read_mtx(spark, "viewfs://box/data/plain.mtx")) == [(0, 1, 1.0), (1, 1, 10.0), (2, 2, 5.0), (2, 2, 5.0)]


def test_gram_in_half_the_cells(spark):
    rng = random.Random(21)
    rows = [(rng.randrange(25), rng.randrange(12), float(rng.randint(1, 5))) for _ in range(120)] + [(4, k, 1.0) for k in range(12)]
    a = SparseMatrix.from_entries(spark, rows, 25, 12)
    key = lambda m: sorted(map(tuple, m.df.collect()))
    for blocks in (None, 1, 2, 7):
        assert key(R.grid_gram(a, blocks=blocks)) == key(P.gram(a)) == key(P.spgemm(a, a.transpose()))
        assert key(R.grid_gram(a, True, blocks)) == key(P.gram(a, True))
    assert sorted((r["i"], r["j"]) for r in R.grid_project(a, a.transpose()).collect()) == sorted((r["i"], r["j"]) for r in P.join_project(a, a.transpose()).collect())

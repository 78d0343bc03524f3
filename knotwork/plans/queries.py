"""Registered queries over the driver's tables, each with the SQL that DuckDB
answers it with. Matrices: sp (supplier x part, summed quantity), cp (customer
x part), op (order x part), ue (user x event type), pp (parts that share an
order). All take their whole tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import matrix as M
from ..functions import text as T
from ..matrix import Extent, SparseMatrix, larger
from ..operators import graph as G
from ..operators import grid as R
from ..operators import layout as L
from ..operators import metapath as H
from ..operators import product as P
from ..operators import similarity as J
from ..operators import stats as S
from ..sources import files, hin as B, mtx, store
from ..storage import materialize, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def sp(s: SparkSession, d: str) -> SparseMatrix:
    lines = _t(s, d, "lineitem")
    # dealt by part alone, as products of the matrix and its transpose want it, to a number of tasks
    # that is given, since adaptive execution would make a few large ones of them for the aggregation
    n = int(s.conf.get("spark.sql.shuffle.partitions"))
    li = lines.select("l_suppkey", "l_partkey", "l_quantity").repartition(n, "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return SparseMatrix.of(li, "l_suppkey", "l_partkey", "q", bounds=lines)


def cp(s: SparkSession, d: str) -> SparseMatrix:
    j = _t(s, d, "orders").join(_t(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey")
    return SparseMatrix.of(j.distinct(), "o_custkey", "l_partkey", bounds=j)


def op(s: SparkSession, d: str) -> SparseMatrix:
    lines = _t(s, d, "lineitem").select("l_orderkey", "l_partkey")
    return SparseMatrix.of(lines.distinct(), "l_orderkey", "l_partkey", bounds=lines)


def ue(s: SparkSession, d: str) -> SparseMatrix:
    e = _t(s, d, "events").select("user_id", "event_type").distinct()
    # event types are few; their ids are ranks by name
    e = L.remap_dense(e, "event_type")
    return SparseMatrix.of(e, "user_id", "event_type")


def pp(s: SparkSession, d: str, once: bool = True) -> SparseMatrix:
    """Pairs of parts of an order, over all orders; an order has a few parts. Lines
    are dealt by order once, for both sides, and pairs by their first part, unless
    a pair may come again for each order that has it."""
    li = _t(s, d, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    e = li.alias("x").join(li.alias("y"), "l_orderkey").where("x.l_partkey < y.l_partkey").selectExpr("x.l_partkey as i", "y.l_partkey as j")
    return SparseMatrix.of(e.repartition("i").distinct() if once else e, "i", "j", bounds=e)


def hin(s: SparkSession, d: str) -> H.TypedGraph:
    """Relations of suppliers, customers, orders and parts; each is made when a path asks for it."""
    orders, lines = _t(s, d, "orders"), _t(s, d, "lineitem")
    largest = lambda df, c: Extent(lambda: df.agg(F.coalesce(F.max(c) + 1, F.lit(0))).first()[0])
    n = {"S": largest(lines, "l_suppkey"), "P": largest(lines, "l_partkey"), "C": largest(orders, "o_custkey")}
    n["O"] = larger(largest(orders, "o_orderkey"), largest(lines, "l_orderkey"))
    of = lambda pair, df: SparseMatrix(df, n[pair[0]], n[pair[1]])
    return H.TypedGraph({
        ("S", "P"): lambda: of("SP", lines.selectExpr("l_suppkey AS i", "l_partkey AS j").distinct().withColumn("v", F.lit(1.0))),
        ("C", "O"): lambda: of("CO", SparseMatrix.of(orders, "o_custkey", "o_orderkey").df),
        ("O", "P"): lambda: of("OP", op(s, d).df),
        ("C", "P"): lambda: of("CP", cp(s, d).df),
    })


def papers(s: SparkSession, d: str) -> DataFrame:
    """Documents as publication records: the text is the title, the language and the
    source are the authors, and the source is the venue."""
    docs = _t(s, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"), F.array("lang", "source", "lang").alias("authors"), F.col("source").alias("venue"), F.col("doc_id").alias("_line"))


def _folder(s: SparkSession) -> str:
    """A new path in the shared folder, without the scheme of local files. What lies
    there is read when the result is, so it goes when the driver ends."""
    path = f"{re.sub('^file:(//)?(?=/)', '', shared_folder(s))}/round-trip-{uuid.uuid4().hex}"
    conf, kind = s.sparkContext._jsc.hadoopConfiguration(), s.sparkContext._jvm.org.apache.hadoop.fs.Path

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            system = kind(path).getFileSystem(conf)
            for x in system.globStatus(kind(f"{path}*")) or []:
                system.delete(x.getPath(), True)

    atexit.register(remove)
    return path


_SP = "sp AS (SELECT l_suppkey AS i, l_partkey AS j, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_CP = "cp AS (SELECT DISTINCT o_custkey AS i, l_partkey AS j FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_OP = "op AS (SELECT DISTINCT l_orderkey AS i, l_partkey AS j FROM lineitem)"
_UE = "ue AS (SELECT DISTINCT user_id AS i, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS j FROM events)"
_PP = "li AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), pp AS (SELECT DISTINCT x.p AS i, y.p AS j FROM li x JOIN li y USING (o) WHERE x.p < y.p)"
_ROWS = "r AS (SELECT unnest(range(0, (SELECT max(i) + 1 FROM sp))) AS i)"
_FLOP = f"{_SP}, {_ROWS}, nb AS (SELECT j, COUNT(*) AS n FROM sp GROUP BY j), fl AS (SELECT i, CAST(SUM(n) AS BIGINT) AS flop FROM sp JOIN nb USING (j) GROUP BY i), fr AS (SELECT r.i, COALESCE(flop, 0) AS flop FROM r LEFT JOIN fl USING (i))"
_CF = f"{_FLOP}, nz AS (SELECT a.i, COUNT(DISTINCT b.i) AS nnz FROM sp a JOIN sp b USING (j) GROUP BY a.i), cf AS (SELECT fr.i, flop, COALESCE(nnz, 0) AS nnz FROM fr LEFT JOIN nz USING (i))"
_SYM = f"{_PP}, nv AS (SELECT max(greatest(i, j)) + 1 AS n FROM pp), vs AS (SELECT unnest(range(0, (SELECT n FROM nv))) AS i), dg AS (SELECT vs.i, COUNT(pp.i) AS degree FROM vs LEFT JOIN pp USING (i) GROUP BY vs.i), rk AS (SELECT i, degree, row_number() OVER (ORDER BY degree, i) - 1 AS rank FROM dg), sy AS (SELECT i, j FROM pp UNION SELECT j, i FROM pp), pe AS (SELECT x.rank AS i, y.rank AS j FROM sy JOIN rk x ON sy.i = x.i JOIN rk y ON sy.j = y.i)"
_PATH = "WITH {0}, d AS (SELECT i, SUM(v * v) AS d FROM ml GROUP BY i), q AS (SELECT j, v FROM ml WHERE i = {1}) SELECT ml.i AS id, round(2 * SUM(ml.v * q.v) / (any_value(d.d) + (SELECT d FROM d WHERE i = {1})), 9) AS score FROM ml JOIN q USING (j) JOIN d ON d.i = ml.i GROUP BY ml.i ORDER BY 2 DESC, 1 LIMIT {2}"
_SEARCH = "WITH {0}, d AS (SELECT i, SUM(v * v) AS d FROM ml GROUP BY i), m AS (SELECT q.i AS query, ml.i AS id, SUM(ml.v * q.v) AS m FROM ml q JOIN ml USING (j) WHERE q.i % 20 = 0 GROUP BY 1, 2), r AS (SELECT query, id, 2 * m / (x.d + y.d) AS score FROM m JOIN d x ON x.i = query JOIN d y ON y.i = id), p AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS place, id, score FROM r) SELECT query, place, id, round(score, 9) AS score FROM p WHERE place <= {1}"
_WORK = f"{_FLOP}, s AS (SELECT COUNT(*) AS n, SUM(flop) AS total FROM fr), c AS (SELECT flop, row_number() OVER (ORDER BY flop DESC, i) AS k, SUM(flop) OVER (ORDER BY flop DESC, i ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (ORDER BY flop, i) AS up FROM fr)"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS = f"w AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS term FROM documents), tf AS (SELECT term, COUNT(*) AS df FROM w WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY term HAVING COUNT(*) >= 2)"
_SPP = "spgemm AS (SELECT a.i, b.i AS j, SUM(a.v * b.v) AS v FROM sp a JOIN sp b USING (j) GROUP BY 1, 2)"


def _conc(s: SparkSession, d: str) -> DataFrame:
    a = sp(s, d)
    return S.concentration(S.flop_per_row(a, a.transpose()))


def _score(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 9).alias("score"))


def _search(ml: SparseMatrix, k: int, names: DataFrame | None = None) -> DataFrame:
    """The search of every id divisible by 20."""
    got = R.pathsim_search(ml, ml.df.where("i % 20 = 0").select(F.col("i").alias("id")), k, names)
    return got.withColumn("score", F.round("score", 9))


def _chain3(s: SparkSession, d: str) -> DataFrame:
    return _score(H.pathsim_topk(H.metapath_product(hin(s, d), H.left_half("COPOC")), 1, 10))


def _minplus(s: SparkSession, d: str) -> DataFrame:
    a = sp(s, d)
    return P.spgemm(a, a.transpose(), mul=P.plus, add=F.min).df


def _fit(s: SparkSession, d: str) -> DataFrame:
    fit = S.powerlaw_fit(cp(s, d).row_counts(), "nnz") or {"alpha": None, "xmin": None, "ks": None, "tail": None}
    return s.createDataFrame([tuple(fit[k] if k == "tail" or fit[k] is None else round(fit[k], 9) for k in ("alpha", "xmin", "ks", "tail"))], "alpha double, xmin double, ks double, tail long")


_FIT = f"""WITH {_CP}, h AS (SELECT x, COUNT(*) AS n FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS x FROM cp GROUP BY i) GROUP BY x),
q AS (SELECT CASE WHEN (SELECT COUNT(*) FROM h) > 200 THEN quantile_cont(x, list_transform(range(200), lambda k: 0.95 * k / 199)) ELSE list(x) END AS xs FROM h),
cand AS (SELECT DISTINCT unnest(xs) AS xm FROM q),
f AS (SELECT xm, SUM(n) AS tail, SUM(n * ln(x / (xm - 0.5))) AS logs FROM cand JOIN h ON x >= xm WHERE xm >= 1 GROUP BY xm HAVING SUM(n) >= 50),
g AS (SELECT xm, tail, 1 + tail / logs AS alpha FROM f WHERE logs > 0),
c AS (SELECT xm, alpha, tail, n, SUM(n) OVER (PARTITION BY xm ORDER BY x) AS seen, 1 - pow(x / xm, 1 - alpha) AS m FROM g JOIN h ON x >= xm WHERE alpha > 1),
k AS (SELECT xm, alpha, tail, MAX(greatest(abs(seen / tail - m), abs((seen - n + 1) / tail - m))) AS ks FROM c GROUP BY 1, 2, 3)
SELECT round(alpha, 9) AS alpha, round(xm, 9) AS xmin, round(ks, 9) AS ks, CAST(tail AS BIGINT) AS tail FROM k ORDER BY k.ks, xm LIMIT 1"""


def _analyse(s: SparkSession, d: str) -> DataFrame:
    a = sp(s, d)
    got = S.analyse(S.flop_per_row(a, a.transpose()))
    whole = ["n", "max", "nonzero", "crossover_k"]
    parts = ["sum", "mean", "crossover_row_frac", "crossover_mass_frac", "top10pct_share", "rows_for_90pct", "thread_fair_share", "rows_for_one_thread"]
    return got.select(*whole, *(F.round(c, 9).alias(c) for c in parts))


_ANALYSE = """SELECT any_value(n) AS n, CAST(any_value(mx) AS BIGINT) AS max, CAST(any_value(nz) AS BIGINT) AS nonzero, CAST(any_value(x) AS BIGINT) AS crossover_k, CAST(any_value(total) AS DOUBLE) AS sum,
round(any_value(total) / CAST(any_value(n) AS DOUBLE), 9) AS mean, round(any_value(x) / CAST(any_value(n) AS DOUBLE), 9) AS crossover_row_frac, round(MAX(c) FILTER (k = x) / CAST(any_value(total) AS DOUBLE), 9) AS crossover_mass_frac,
round(MAX(c) FILTER (k = greatest(1, round_even(n * 0.1, 0))) / CAST(any_value(total) AS DOUBLE), 9) AS top10pct_share, round((COUNT(*) FILTER (c < 0.9 * total) + 1) / CAST(any_value(n) AS DOUBLE), 9) AS rows_for_90pct,
round(any_value(total) / 64.0, 9) AS thread_fair_share, round((COUNT(*) FILTER (c < total / 64.0) + 1) / CAST(any_value(n) AS DOUBLE), 9) AS rows_for_one_thread
FROM c, s, (SELECT COUNT(*) FILTER (c <= total / 2.0) + 1 AS x, MAX(flop) AS mx, COUNT(*) FILTER (flop > 0) AS nz FROM c, s)"""


def _round_trip(kind: str) -> Query:
    """The supplier x part matrix, or the part graph, written and read again."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = _folder(s)
        if kind == "edges":
            g = pp(s, d)
            files.write_edges(g, path)
            return files.read_edges(s, path, both=True, n=g.n_rows).df
        a = sp(s, d)
        if kind == "bin":
            mtx.write_bin(a, f"{path}.bin")
            return mtx.read_matrix(s, f"{path}.bin").df
        if kind == "pair":
            mtx.write_mtx(a, f"{path}.org", "ones")
            mtx.write_mtx(a.transpose(), f"{path}.trs", "ones")
            return mtx.load_pair(s, path.rsplit("/", 1)[1], path.rsplit("/", 1)[0])[1].df
        mtx.write_mtx(a, f"{path}.mtx")
        return mtx.read_matrix(s, f"{path}.mtx").df

    return run


def _stored(s: SparkSession, d: str) -> DataFrame:
    """The product of a stored matrix and its transpose, joined bucket by bucket."""
    path = _folder(s)
    name = f"stored_{path.rsplit('-', 1)[1]}"
    store.save(sp(s, d), name, path, max(8, int(s.conf.get("spark.sql.shuffle.partitions"))))
    a = store.load(s, name)
    return store.stored_spgemm(a, a.transpose()).df


def _guarded(s: SparkSession, d: str) -> DataFrame:
    """What each product of a path takes, and whether the guard lets it pass."""
    steps = hin(s, d).steps("SPO")
    n = P.flop_total(*steps)
    refused = False
    try:
        P.spgemm(*steps, most=n - 1)
    except ValueError:
        refused = True
    return s.range(1).select(F.lit(n).cast("long").alias("flop"), F.lit(refused).alias("refused"))


def _step_report(s: SparkSession, d: str) -> DataFrame:
    """Skew of the work of each step of customer, order, part, supplier."""
    rows = [S.concentration(df).select(F.lit(k).alias("step"), "crossover", F.round("gini", 9).alias("gini")) for k, df in enumerate(H.step_work(hin(s, d), "COPSPOC"))]
    return reduce(DataFrame.unionByName, rows)


def _ordered(df: DataFrame, *columns: str, descending: bool = False) -> DataFrame:
    """Rows in order with their places, as a reader of the written order sees them."""
    held = L.ordered(df, *columns, descending=descending)
    way = F.desc if descending else F.asc
    order = [*(way(c) for c in columns), *(c for c in df.columns if c not in columns)]
    return L.global_rank(held, [o if not isinstance(o, str) else F.asc(o) for o in order], "place")


def _json(s: SparkSession, d: str) -> DataFrame:
    """Author edges of the graph read from JSON lines."""
    path = _folder(s)
    papers(s, d).orderBy("_line").drop("_line").write.json(path)
    p = B.from_json(s, path)
    return p.ap.join(p.authors, "aid").join(p.papers, "pid").select(F.col("name"), F.col("id").cast("long").alias("id"), "pid")


def _dimacs(s: SparkSession, d: str) -> DataFrame:
    """Weighted arcs from suppliers to parts, written as a graph and read again."""
    path, a = _folder(s), sp(s, d)
    n = larger(a.rows, a.cols)
    files.write_dimacs(SparseMatrix(a.df, n, n), path)
    return files.read_dimacs(s, path).df


def _sorted_csv(s: SparkSession, d: str) -> DataFrame:
    """Lines of the sorted table of a matrix."""
    path = _folder(s)
    files.write_sorted_csv(sp(s, d), path)
    return s.read.text(path).withColumnRenamed("value", "line")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    files.write_edges(op(s, d), path)
    return files.read_pairs(s, path)


def _names(s: SparkSession, d: str) -> DataFrame:
    """The vocabulary as a table of names, written and read again."""
    path = _folder(s)
    files.write_names(T.vocabulary(_t(s, d, "documents"), "text").select(F.col("term_id").alias("id"), F.col("term").alias("name")), path)
    return files.read_names(s, path)


def _ratings(s: SparkSession, d: str) -> DataFrame:
    """How often each user had each type of event, as ratings with a fourth column."""
    path = _folder(s)
    rated = _t(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("rating"), F.lit("x").alias("more"))
    rated.write.csv(path, header=True)
    got = files.read_ratings(s, path)
    return got.select(F.col("user").cast("long").alias("user_id"), F.col("item"), F.col("rating").cast("long").alias("rating"))


def _principals(s: SparkSession, d: str) -> DataFrame:
    """Orders as titles and their lines as principals, in gzipped tables."""
    path = _folder(s)
    coded = lambda kind, c: F.concat(F.lit(kind), F.lpad(F.col(c).cast("string"), 9, "0"))
    titles = _t(s, d, "orders").select(coded("tt", "o_orderkey").alias("tconst"), F.col("o_orderstatus").alias("titleType"))
    people = _t(s, d, "lineitem").select(coded("tt", "l_orderkey").alias("tconst"), coded("nm", "l_suppkey").alias("nconst"), F.col("l_returnflag").alias("category"))
    for df, kind in ((titles, "titles"), (people, "people")):
        df.write.csv(f"{path}-{kind}", sep="\t", header=True, quote="", compression="gzip")
    wanted = files.read_title_types(s, f"{path}-titles", ["F", "P"])
    return files.read_principals(s, f"{path}-people", ["A"], wanted)


def _split_json(s: SparkSession, d: str) -> DataFrame:
    """Fields of JSON lines by pattern, and how many lines there are."""
    path = _folder(s)
    papers(s, d).drop("_line").write.json(path)
    return files.split_json(s, path, ["id", "venue"]).withColumn("lines", F.lit(files.count_lines(s, path)).cast("long"))


def _written_once(s: SparkSession, d: str) -> DataFrame:
    """Lines as entries that repeat, written without repeats and read again."""
    path = f"{_folder(s)}.mtx"
    mtx.write_mtx(SparseMatrix.of(_t(s, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity"), path, dedup=True)
    return mtx.read_matrix(s, path).df


def _log(s: SparkSession, d: str) -> DataFrame:
    """Figures of a log with terminal colours, one line for each order."""
    lines = _t(s, d, "orders").select(F.format_string("\x1b[31m%s: order %d\x1b[0m", "o_orderpriority", "o_orderkey").alias("value"))
    return T.parse_log(lines)


def _subset_matrices(s: SparkSession, d: str) -> DataFrame:
    matrices, _, _ = B.subset(B.build(papers(s, d)), 5, 2, None, 3)
    return matrices["pt"].df.groupBy("i").agg(F.count("*").alias("n"), F.sum("j").alias("terms"))


def _paper_search(s: SparkSession, d: str) -> DataFrame:
    """Papers most similar by their terms, with their names, over the built graph."""
    p = B.build(papers(s, d))
    pt = SparseMatrix.of(p.pt, "pid", "tid")
    # a paper has a term once
    got = R.overlap_search(pt, pt.df.where("i % 20 = 0").select(F.col("i").alias("id")), 5, p.papers.select(F.col("pid").alias("id"), F.col("id").alias("name")))
    return got.withColumn("score", F.round("score", 9))


def _author_search(s: SparkSession, d: str) -> DataFrame:
    """The path author, paper, term, paper, author for every author, with names."""
    p = B.build(papers(s, d))
    a, t = SparseMatrix.of(p.ap, "aid", "pid"), SparseMatrix.of(p.pt, "pid", "tid")
    n = larger(a.cols, t.rows)
    # the product reads its factors several times, and the search the product
    g = H.TypedGraph({("A", "P"): SparseMatrix(materialize(a.df), a.rows, n), ("P", "T"): SparseMatrix(materialize(t.df), n, t.cols)})
    names = p.authors.select(F.col("aid").alias("id"), "name")
    ml = H.metapath_product(g, H.left_half("APTPA"), most=None)
    ml = ml.with_df(materialize(ml.df))
    return R.pathsim_search(ml, p.authors.select(F.col("aid").alias("id")), 3, names).withColumn("score", F.round("score", 9))


def _subset(s: SparkSession, d: str) -> DataFrame:
    o, li = _t(s, d, "orders"), _t(s, d, "lineitem")
    ap = o.select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("p"))
    c = li.select(F.col("l_suppkey").alias("c"), F.col("l_orderkey").alias("p")).distinct()
    pt = li.select(F.col("l_orderkey").alias("p"), F.col("l_partkey").alias("t")).distinct()
    _, _, terms = H.subset(ap, c, pt, venues=5, min_papers=2, min_df=2)
    return terms.groupBy("t").agg(F.count("*").alias("n"))


def _table() -> dict[str, tuple[Query, str | None]]:
    sq = lambda s, d: (lambda a: (a, a.transpose()))(sp(s, d))
    return {
        "load_coo": (lambda s, d: sp(s, d).df, f"WITH {_SP} SELECT i, j, v FROM sp"),
        "transpose": (lambda s, d: sp(s, d).transpose().df, f"WITH {_SP} SELECT j AS i, i AS j, v FROM sp"),
        "ones": (lambda s, d: sp(s, d).ones().df, f"WITH {_SP} SELECT i, j, CAST(1 AS DOUBLE) AS v FROM sp"),
        "symmetrize": (lambda s, d: pp(s, d).symmetrize().df, f"WITH {_SYM} SELECT i, j, CAST(1 AS DOUBLE) AS v FROM sy"),
        "drop_diag": (lambda s, d: sp(s, d).drop_diagonal().df, f"WITH {_SP} SELECT i, j, v FROM sp WHERE i <> j"),
        "tril": (lambda s, d: sp(s, d).tril().df, f"WITH {_SP} SELECT i, j, v FROM sp WHERE i > j"),
        "triu": (lambda s, d: sp(s, d).triu().df, f"WITH {_SP} SELECT i, j, v FROM sp WHERE i < j"),
        "rebase": (lambda s, d: sp(s, d).rebase(1).df, f"WITH {_SP} SELECT i + 1 AS i, j + 1 AS j, v FROM sp"),
        "merge_duplicates": (lambda s, d: SparseMatrix.of(_t(s, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity").merge_duplicates(F.max).df, "SELECT l_suppkey AS i, l_partkey AS j, MAX(l_quantity) AS v FROM lineitem GROUP BY 1, 2"),
        "csr_view_rowptr": (lambda s, d: sp(s, d).row_pointers(), f"WITH {_SP}, {_ROWS}, n AS (SELECT r.i, COUNT(sp.i) AS n FROM r LEFT JOIN sp USING (i) GROUP BY r.i) SELECT i, CAST(COALESCE(SUM(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_ptr FROM n"),
        "csr_round_trip": (lambda s, d: (lambda a: SparseMatrix.from_csr(a.to_csr(), a.n_rows, a.n_cols).df)(sp(s, d)), f"WITH {_SP} SELECT i, j, v FROM sp"),
        "csc_round_trip": (lambda s, d: (lambda a: SparseMatrix.from_csc(a.to_csc(), a.n_rows, a.n_cols).df)(sp(s, d)), f"WITH {_SP} SELECT i, j, v FROM sp"),
        "intersect_ids": (lambda s, d: M.intersect(_t(s, d, "orders").selectExpr("o_custkey AS id"), _t(s, d, "lineitem").selectExpr("l_suppkey * 2 AS id"), "id"), "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IN (SELECT l_suppkey * 2 FROM lineitem)"),
        "keep_mask": (lambda s, d: M.keep_mask(sp(s, d).df, "j", s.range(0, 1000, 3).toDF("j")).groupBy("i", "kept").agg(F.count("*").alias("n")), f"WITH {_SP} SELECT i, j % 3 = 0 AND j < 1000 AS kept, COUNT(*) AS n FROM sp GROUP BY 1, 2"),
        "dense_sample": (lambda s, d: T.dense_sample(T.sample_top(_t(s, d, "events"), "user_id", 20, "event_id"), "user_id", "event_type").df, "WITH u AS (SELECT user_id FROM events GROUP BY user_id ORDER BY COUNT(*) DESC, MIN(event_id), user_id LIMIT 20), e AS (SELECT DISTINCT user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM u)) SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS i, dense_rank() OVER (ORDER BY event_type) - 1 AS j, CAST(1 AS DOUBLE) AS v FROM e"),
        "spref": (lambda s, d: sp(s, d).ref(s.range(0, 1000, 3), s.range(0, 1000, 7)).df, f"WITH {_SP} SELECT i // 3 AS i, j // 7 AS j, v FROM sp WHERE i % 3 = 0 AND j % 7 = 0 AND i < 1000 AND j < 1000"),
        "spref_keep_ids": (lambda s, d: sp(s, d).ref(s.range(0, 1000, 3), None, "none").df, f"WITH {_SP} SELECT i, j, v FROM sp WHERE i % 3 = 0 AND i < 1000"),
        "row_split": (lambda s, d: sp(s, d).split_rows(7).groupBy("part").agg(F.count("*").alias("nnz")), f"WITH {_SP}, m AS (SELECT CAST(ceil((max(i) + 1) / 7.0) AS BIGINT) AS per FROM sp) SELECT i // per AS part, COUNT(*) AS nnz FROM sp, m GROUP BY 1"),
        "degree_row": (lambda s, d: sp(s, d).row_counts(), f"WITH {_SP}, {_ROWS} SELECT r.i, COUNT(sp.i) AS nnz FROM r LEFT JOIN sp USING (i) GROUP BY r.i"),
        "degree_col": (lambda s, d: sp(s, d).df.groupBy("j").agg(F.count("*").alias("nnz")), f"WITH {_SP} SELECT j, COUNT(*) AS nnz FROM sp GROUP BY j"),
        "max_row_nnz": (lambda s, d: S.max_row_nnz(cp(s, d)), f"WITH {_CP} SELECT MAX(n) AS max_nnz FROM (SELECT COUNT(*) AS n FROM cp GROUP BY i)"),
        "flop_per_row": (lambda s, d: S.flop_per_row(*sq(s, d)), f"WITH {_FLOP} SELECT i, flop FROM fr"),
        "flop_total": (lambda s, d: s.createDataFrame([(P.flop_total(*sq(s, d)),)], "flop long"), f"WITH {_FLOP} SELECT CAST(SUM(flop) AS BIGINT) AS flop FROM fr"),
        "flop_outer": (lambda s, d: (lambda a: a.df.groupBy("j").count().agg(F.sum(F.col("count") * F.col("count")).alias("flop")))(cp(s, d)), f"WITH {_CP} SELECT CAST(SUM(n * n) AS BIGINT) AS flop FROM (SELECT COUNT(*) AS n FROM cp GROUP BY j)"),
        "nnz_c_per_row": (lambda s, d: S.nnz_per_row(*sq(s, d)), f"WITH {_SP} SELECT a.i, COUNT(DISTINCT b.i) AS nnz FROM sp a JOIN sp b USING (j) GROUP BY a.i"),
        "nnz_c_sketch": (lambda s, d: S.nnz_per_row(*sq(s, d)).join(S.nnz_per_row_sketch(*sq(s, d)).withColumnRenamed("nnz", "near"), "i").select("i", "nnz", (F.abs(F.col("near") - F.col("nnz")) <= 0.08 * F.col("nnz")).alias("within")), f"WITH {_SP} SELECT a.i, COUNT(DISTINCT b.i) AS nnz, TRUE AS within FROM sp a JOIN sp b USING (j) GROUP BY a.i"),
        "compression_factor": (lambda s, d: S.compression_factor(*sq(s, d)).select("i", "flop", "nnz", F.round("cf", 9).alias("cf")), f"WITH {_CF} SELECT i, flop, nnz, round(CASE WHEN nnz = 0 THEN 0.0 ELSE CAST(flop AS DOUBLE) / nnz END, 9) AS cf FROM cf"),
        "bound_check": (lambda s, d: S.bound_check(*sq(s, d)), f'WITH {_CF}, m AS (SELECT max(i) + 1 AS nc FROM sp) SELECT COUNT(*) FILTER (least(flop, nc) > nnz) AS "over", COUNT(*) FILTER (least(flop, nc) < nnz) AS under FROM cf, m'),
        "bin_id": (lambda s, d: S.row_bins(*sq(s, d)), f"WITH {_FLOP}, m AS (SELECT max(i) + 1 AS nc FROM sp) SELECT i, flop, CAST(CASE WHEN flop = 0 THEN 0 ELSE greatest(0, ceil(log2(least(flop, nc) / 8.0))) + 1 END AS INTEGER) AS bin FROM fr, m"),
        "exclusive_scan": (lambda s, d: L.exclusive_scan(S.flop_per_row(*sq(s, d)), "i", "flop"), f"WITH {_FLOP} SELECT i, flop, CAST(COALESCE(SUM(flop) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM fr"),
        "balanced_ranges": (lambda s, d: L.balanced_ranges(S.flop_per_row(*sq(s, d)), 8).groupBy("part").agg(F.min("i").alias("first"), F.count("*").alias("n")), f'WITH {_FLOP}, x AS (SELECT i, COALESCE(SUM(flop) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix, ceil(SUM(flop) OVER () / 8.0) AS share FROM fr) SELECT CAST(least(floor(prefix / share), 7) AS BIGINT) AS part, MIN(i) AS "first", COUNT(*) AS n FROM x GROUP BY 1'),
        "row_hotness": (lambda s, d: (lambda a: S.row_hotness(a, a.transpose()).select("k", "refs", F.round("freq", 12).alias("freq"), "nnz"))(sp(s, d)), f"WITH {_SP} SELECT j AS k, COUNT(*) AS refs, round(COUNT(*) / (SELECT COUNT(*) FROM sp), 12) AS freq, COUNT(*) AS nnz FROM sp GROUP BY j HAVING COUNT(*) / (SELECT COUNT(*) FROM sp) > 1e-4"),
        "matrix_stats": (lambda s, d: S.matrix_stats(*sq(s, d)).withColumn("flop_per_nnz", F.round("flop_per_nnz", 9)), f"WITH {_CF} SELECT (SELECT max(i) + 1 FROM sp) AS n_rows, (SELECT max(j) + 1 FROM sp) AS n_cols, (SELECT COUNT(*) FROM sp) AS nnz_a, CAST(SUM(nnz) AS BIGINT) AS nnz_c, CAST(SUM(flop) AS BIGINT) AS flop, round(CAST(SUM(flop) AS DOUBLE) / SUM(nnz), 9) AS flop_per_nnz FROM cf"),
        "checksum": (lambda s, d: R.grid_spgemm(*sq(s, d)).checksum(), f"WITH {_SP}, {_SPP} SELECT COUNT(*) AS nnz, CAST(SUM(j) AS BIGINT) AS sum_col, SUM(v) AS sum_val FROM spgemm"),
        "spgemm_supp_part": (lambda s, d: R.grid_spgemm(*sq(s, d)).df, f"WITH {_SP}, {_SPP} SELECT i, j, v FROM spgemm"),
        "spgemm_join": (lambda s, d: P.spgemm(*sq(s, d)).df, f"WITH {_SP}, {_SPP} SELECT i, j, v FROM spgemm"),
        "spgemm_stored": (_stored, f"WITH {_SP}, {_SPP} SELECT i, j, v FROM spgemm"),
        "spgemm_balanced": (lambda s, d: R.balanced_spgemm(*sq(s, d)).df, f"WITH {_SP}, {_SPP} SELECT i, j, v FROM spgemm"),
        "balanced_cells": (lambda s, d: R.cell_work(*sq(s, d), 4, 4).agg(F.sum("flop").alias("flop"), (F.max("flop") <= 2 * F.median("flop")).alias("even")), f"WITH {_FLOP} SELECT CAST(SUM(flop) AS BIGINT) AS flop, TRUE AS even FROM fr"),
        "spgemm_salted": (lambda s, d: (lambda a: P.salted_spgemm(a, a.transpose()).df)(ue(s, d)), f"WITH {_UE} SELECT a.i, b.i AS j, CAST(COUNT(*) AS DOUBLE) AS v FROM ue a JOIN ue b USING (j) GROUP BY 1, 2"),
        "spgemm_minplus": (_minplus, f"WITH {_SP} SELECT a.i, b.i AS j, MIN(a.v + b.v) AS v FROM sp a JOIN sp b USING (j) GROUP BY 1, 2"),
        "spgemm_maxmin": (lambda s, d: P.spgemm(*sq(s, d), mul=F.least, add=F.max).df, f"WITH {_SP} SELECT a.i, b.i AS j, MAX(least(a.v, b.v)) AS v FROM sp a JOIN sp b USING (j) GROUP BY 1, 2"),
        "spgemm_bool": (lambda s, d: P.spgemm(*sq(s, d), mul=lambda x, y: F.lit(1.0), add=F.max).df, f"WITH {_SP} SELECT DISTINCT a.i, b.i AS j, CAST(1 AS DOUBLE) AS v FROM sp a JOIN sp b USING (j)"),
        "gram_upper": (lambda s, d: R.grid_gram(sp(s, d), True).df, f"WITH {_SP}, {_SPP} SELECT i, j, v FROM spgemm WHERE i <= j"),
        "gram": (lambda s, d: R.grid_gram(sp(s, d)).df, f"WITH {_SP}, {_SPP} SELECT i, j, v FROM spgemm"),
        "join_project": (lambda s, d: (lambda a: R.grid_project(a, a.transpose()))(cp(s, d)).groupBy("cell", "i").agg(F.count("*").alias("n"), F.sum("j").alias("sum_j")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("sum_j").alias("sum_j")), f"WITH {_CP} SELECT a.i, COUNT(DISTINCT b.i) AS n, CAST(SUM(DISTINCT b.i) AS BIGINT) AS sum_j FROM cp a JOIN cp b USING (j) GROUP BY a.i"),
        "join_project_rows": (lambda s, d: (lambda a: P.join_project(a, a.transpose()))(sp(s, d)), f"WITH {_SP} SELECT DISTINCT a.i, b.i AS j FROM sp a JOIN sp b USING (j)"),
        "join_aggregate_partitioned": (lambda s, d: P.join_aggregate(*sq(s, d)).df, f"WITH {_SP}, {_SPP} SELECT i, j, v FROM spgemm"),
        "join_aggregate_broadcast": (lambda s, d: P.join_aggregate(*sq(s, d), partitioned=False).df, f"WITH {_SP}, {_SPP} SELECT i, j, v FROM spgemm"),
        "masked_product": (lambda s, d: (lambda a: P.masked_product(a, a.transpose(), SparseMatrix(s.range(a.n_rows).select(F.col("id").alias("i"), ((F.col("id") * 7 + 3) % a.n_rows).alias("j"), F.lit(1.0).alias("v")), a.n_rows, a.n_rows)).df)(sp(s, d)), f"WITH {_SP}, {_SPP}, n AS (SELECT max(i) + 1 AS n FROM sp) SELECT i, j, v FROM spgemm, n WHERE j = (i * 7 + 3) % n"),
        "spmv_const": (lambda s, d: P.spmv(sp(s, d), 3.0, dense=True), f"WITH {_SP}, {_ROWS} SELECT r.i, COALESCE(3.0 * SUM(v), 0.0) AS v FROM r LEFT JOIN sp USING (i) GROUP BY r.i"),
        "spmv_part_size": (lambda s, d: P.spmv(sp(s, d), _t(s, d, "part").selectExpr("p_partkey as j", "cast(p_size as double) as v")), f"WITH {_SP} SELECT i, SUM(v * p_size) AS v FROM sp JOIN part ON j = p_partkey GROUP BY i"),
        "spmm_k": (lambda s, d: P.spmm(sp(s, d), _t(s, d, "part").select(F.col("p_partkey").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), (F.col("p_size") % 5).cast("double").alias("v")).withColumn("v", F.col("v") + F.col("k"))), f"WITH {_SP}, k AS (SELECT unnest([0, 1, 2, 3]) AS k) SELECT i, k, SUM(v * (p_size % 5 + k)) AS v FROM sp JOIN part ON j = p_partkey CROSS JOIN k GROUP BY i, k"),
        "set_similarity_overlap": (lambda s, d: J.set_similarity(cp(s, d), overlap=4).select("i", "j", "overlap"), f"WITH {_CP} SELECT a.i, b.i AS j, COUNT(*) AS overlap FROM cp a JOIN cp b ON a.j = b.j AND a.i < b.i GROUP BY 1, 2 HAVING COUNT(*) >= 4"),
        "set_similarity_jaccard": (lambda s, d: J.set_similarity(op(s, d), 2, 0.3).select("i", "j", "overlap", F.round("jaccard", 9).alias("jaccard")), f"WITH {_OP}, n AS (SELECT i, COUNT(*) AS n FROM op GROUP BY i), o AS (SELECT a.i, b.i AS j, COUNT(*) AS overlap FROM op a JOIN op b ON a.j = b.j AND a.i < b.i GROUP BY 1, 2 HAVING COUNT(*) >= 2) SELECT o.i, o.j, overlap, round(CAST(overlap AS DOUBLE) / (x.n + y.n - overlap), 9) AS jaccard FROM o JOIN n x ON o.i = x.i JOIN n y ON o.j = y.i WHERE CAST(overlap AS DOUBLE) / (x.n + y.n - overlap) >= 0.3"),
        "set_similarity_links": (lambda s, d: J.similarity_links(op(s, d), 2, 0.3), f"WITH {_OP}, n AS (SELECT i, COUNT(*) AS n, list(j ORDER BY j) AS ks FROM op GROUP BY i), o AS (SELECT a.i, b.i AS j, COUNT(*) AS overlap FROM op a JOIN op b ON a.j = b.j AND a.i <> b.i GROUP BY 1, 2 HAVING COUNT(*) >= 2), l AS (SELECT o.i, COUNT(*) AS links FROM o JOIN n x ON o.i = x.i JOIN n y ON o.j = y.i WHERE CAST(overlap AS DOUBLE) / (x.n + y.n - overlap) >= 0.3 GROUP BY o.i) SELECT n.i, MIN(n.i) OVER (PARTITION BY ks) AS c, COALESCE(links, 0) AS links FROM n LEFT JOIN l USING (i)"),
        "pathsim_sps_topk": (lambda s, d: _score(H.pathsim_topk(H.metapath_product(hin(s, d), "SP"), 0, 10)), _PATH.format("ml AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS j, CAST(1 AS DOUBLE) AS v FROM lineitem)", 0, 10)),
        "pathsim_cpc": (lambda s, d: _score(H.pathsim_topk(H.metapath_product(hin(s, d), "CP"), 1, 10)), _PATH.format(f"{_CP}, ml AS (SELECT i, j, CAST(1 AS DOUBLE) AS v FROM cp)", 1, 10)),
        "pathsim_chain3": (_chain3, _PATH.format(f"{_OP}, ml AS (SELECT o_custkey AS i, j, CAST(COUNT(*) AS DOUBLE) AS v FROM orders JOIN op ON o_orderkey = op.i GROUP BY 1, 2)", 1, 10)),
        "pathsim_sps_search": (lambda s, d: _search(H.metapath_product(hin(s, d), "SP"), 5), _SEARCH.format("ml AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS j, CAST(1 AS DOUBLE) AS v FROM lineitem)", 5)),
        "pathsim_cpc_search": (lambda s, d: _search(H.metapath_product(hin(s, d), "CP"), 5), _SEARCH.format(f"{_CP}, ml AS (SELECT i, j, CAST(1 AS DOUBLE) AS v FROM cp)", 5)),
        "pathsim_chain3_search": (lambda s, d: _search(H.metapath_product(hin(s, d), H.left_half("COPOC")), 5), _SEARCH.format(f"{_OP}, ml AS (SELECT o_custkey AS i, j, CAST(COUNT(*) AS DOUBLE) AS v FROM orders JOIN op ON o_orderkey = op.i GROUP BY 1, 2)", 5)),
        "metapath_cheapest": (lambda s, d: H.metapath_product(hin(s, d), "SPOCP", most=None, cheapest=True).df.groupBy("i").agg(F.count("*").alias("nnz"), F.sum("v").alias("total")), f"WITH {_OP}, s AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS j FROM lineitem), a AS (SELECT s.i, op.i AS o, COUNT(*) AS v FROM s JOIN op USING (j) GROUP BY 1, 2), b AS (SELECT a.i, o_custkey AS c, SUM(v) AS v FROM a JOIN orders ON o_orderkey = o GROUP BY 1, 2), {_CP}, e AS (SELECT b.i, cp.j, SUM(b.v) AS v FROM b JOIN cp ON cp.i = b.c GROUP BY 1, 2) SELECT i, COUNT(*) AS nnz, CAST(SUM(v) AS DOUBLE) AS total FROM e GROUP BY i"),
        "product_guard": (_guarded, f"WITH {_OP}, s AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS j FROM lineitem) SELECT COUNT(*) AS flop, TRUE AS refused FROM s JOIN op USING (j)"),
        "step_work_report": (_step_report, f"WITH {_OP}, co AS (SELECT o_custkey AS i, o_orderkey AS j FROM orders), ps AS (SELECT l_partkey AS i, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), oc AS (SELECT i, COUNT(*) AS n FROM op GROUP BY i), r AS (SELECT unnest(range(0, (SELECT max(o_custkey) + 1 FROM orders))) AS i), w0 AS (SELECT co.i, SUM(n) AS flop FROM co JOIN oc ON co.j = oc.i GROUP BY 1), cpo AS (SELECT co.i, op.j FROM co JOIN op ON op.i = co.j GROUP BY 1, 2), w1 AS (SELECT cpo.i, SUM(n) AS flop FROM cpo JOIN ps ON cpo.j = ps.i GROUP BY 1), f AS (SELECT 0 AS step, r.i, COALESCE(flop, 0) AS flop FROM r LEFT JOIN w0 USING (i) UNION ALL SELECT 1, r.i, COALESCE(flop, 0) FROM r LEFT JOIN w1 USING (i)), s AS (SELECT step, COUNT(*) AS n, SUM(flop) AS total FROM f GROUP BY step), c AS (SELECT step, flop, SUM(flop) OVER (PARTITION BY step ORDER BY flop DESC, i ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY step ORDER BY flop, i) AS up FROM f) SELECT CAST(step AS INTEGER) AS step, CAST(COUNT(*) FILTER (c <= total / 2.0) + 1 AS BIGINT) AS crossover, round(2.0 * SUM(up * flop) / (any_value(n) * CAST(any_value(total) AS DOUBLE)) - (any_value(n) + 1.0) / any_value(n), 9) AS gini FROM c JOIN s USING (step) GROUP BY step"),
        "sort_triples": (lambda s, d: _ordered(sp(s, d).df, "i", "j"), f"WITH {_SP} SELECT i, j, v, row_number() OVER (ORDER BY i, j, v) - 1 AS place FROM sp"),
        "sort_pairs_by_value": (lambda s, d: _ordered(sp(s, d).df.select(F.col("j").alias("key"), F.col("v").alias("value")), "value", descending=True), f"WITH {_SP} SELECT j AS key, v AS value, row_number() OVER (ORDER BY v DESC, j) - 1 AS place FROM sp"),
        "range_search": (lambda s, d: (lambda w: L.range_search(L.exclusive_scan(w, "i", "flop"), "i", "prefix", w.select((F.col("i") * 1000).alias("t"))))(S.flop_per_row(*sq(s, d))), f"WITH {_FLOP}, x AS (SELECT i, COALESCE(SUM(flop) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM fr) SELECT t.i * 1000 AS t, MIN(x.i) AS at FROM fr t LEFT JOIN x ON x.prefix >= t.i * 1000 GROUP BY 1"),
        "spmm_alpha_beta": (lambda s, d: (lambda b: P.spmm(sp(s, d), b, 2.0, 0.5, P.spmm(sp(s, d), b)))(_t(s, d, "part").select(F.col("p_partkey").alias("j"), F.lit(0).alias("k"), F.col("p_size").cast("double").alias("v"))), f"WITH {_SP} SELECT i, 0 AS k, 2.5 * SUM(v * p_size) AS v FROM sp JOIN part ON j = p_partkey GROUP BY i"),
        "pathsim_diag": (lambda s, d: H.diagonal(sp(s, d)), f"WITH {_SP} SELECT i, SUM(v * v) AS d FROM sp GROUP BY i"),
        "pathsim_all_topk": (lambda s, d: R.pathsim_all(sp(s, d), 3).withColumn("score", F.round("score", 9)), f"WITH {_SP}, {_SPP}, d AS (SELECT i, SUM(v * v) AS d FROM sp GROUP BY i), x AS (SELECT m.i, m.j, 2 * m.v / (a.d + b.d) AS score FROM spgemm m JOIN d a ON m.i = a.i JOIN d b ON m.j = b.i WHERE m.i <> m.j), y AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS k FROM x) SELECT i, j, round(score, 9) AS score FROM y WHERE k <= 3"),
        "triangle_count": (lambda s, d: G.triangle_count(pp(s, d, once=False)), f"WITH {_PP} SELECT COUNT(*) AS triangles FROM pp a JOIN pp b ON a.j = b.i JOIN pp c ON c.i = a.i AND c.j = b.j"),
        "masked_edge_count": (lambda s, d: G.masked_edge_count(pp(s, d)), f"WITH {_SYM}, lo AS (SELECT i, j FROM pe WHERE i > j), h AS (SELECT DISTINCT a.i, b.i AS j FROM lo a JOIN lo b ON a.j = b.j AND a.i > b.i JOIN lo m ON m.i = a.i AND m.j = b.i) SELECT COUNT(*) AS l, COUNT(*) AS u, 2 * COUNT(*) AS total FROM h"),
        "wedge_count": (lambda s, d: s.createDataFrame([(G.wedge_count(pp(s, d)),)], "wedges long"), f"WITH {_SYM} SELECT COUNT(*) AS wedges FROM pe a JOIN pe b ON a.j = b.i WHERE a.i > a.j AND b.i < b.j"),
        "permute_by_degree": (lambda s, d: G.permute_by_degree(pp(s, d)).df, f"WITH {_SYM} SELECT x.rank AS i, y.rank AS j, CAST(1 AS DOUBLE) AS v FROM pp JOIN rk x ON pp.i = x.i JOIN rk y ON pp.j = y.i"),
        "crossover": (lambda s, d: _conc(s, d).select("crossover"), f"WITH {_WORK} SELECT CAST(COUNT(*) FILTER (c <= total / 2.0) + 1 AS BIGINT) AS crossover FROM c, s"),
        "mass_at_top": (lambda s, d: _conc(s, d).select(F.round("mass_at_top", 9).alias("mass")), f"WITH {_WORK} SELECT round(CAST(SUM(flop) FILTER (k <= greatest(1, round_even(n * 0.1, 0))) AS DOUBLE) / any_value(total), 9) AS mass FROM c, s"),
        "rows_for_mass": (lambda s, d: _conc(s, d).select(F.round("rows_for_mass", 9).alias("share")), f"WITH {_WORK} SELECT round((COUNT(*) FILTER (c < 0.5 * total) + 1) / CAST(any_value(n) AS DOUBLE), 9) AS share FROM c, s"),
        "gini": (lambda s, d: _conc(s, d).select(F.round("gini", 9).alias("gini")), f"WITH {_WORK} SELECT round(2.0 * SUM(up * flop) / (any_value(n) * CAST(any_value(total) AS DOUBLE)) - (any_value(n) + 1.0) / any_value(n), 9) AS gini FROM c, s"),
        "thread_bound": (lambda s, d: _conc(s, d).select(F.round("hot", 9).alias("hot"), F.round("thread_rows", 9).alias("thread_rows")), f"WITH {_WORK} SELECT round(MAX(flop) / (any_value(total) / 64.0), 9) AS hot, round((COUNT(*) FILTER (c < total / 64.0) + 1) / CAST(any_value(n) AS DOUBLE), 9) AS thread_rows FROM c, s"),
        "powerlaw_fit": (_fit, _FIT),
        "top_by_degree": (lambda s, d: L.top_k(sp(s, d).row_counts(), 10, "nnz", "i"), f"WITH {_SP} SELECT i, COUNT(*) AS nnz FROM sp GROUP BY i ORDER BY 2 DESC, 1 LIMIT 10"),
        "heaviest_rows_share": (lambda s, d: S.heaviest_rows(S.flop_per_row(*sq(s, d)), 10).withColumn("share", F.round("share", 9)), f"WITH {_WORK} SELECT i, flop, round(CAST(flop AS DOUBLE) / total, 9) AS share FROM fr, s ORDER BY flop DESC, i LIMIT 10"),
        "degree_filter": (lambda s, d: H.degree_filter(cp(s, d), 5, 60).df.select("i", "j"), f"WITH {_CP} SELECT i, j FROM cp WHERE i IN (SELECT i FROM cp GROUP BY i HAVING COUNT(*) BETWEEN 5 AND 60)"),
        "remap_dense": (lambda s, d: L.remap_dense(_t(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey"), "SELECT dense_rank() OVER (ORDER BY o_custkey) - 1 AS o_custkey, dense_rank() OVER (ORDER BY o_orderkey) - 1 AS o_orderkey FROM orders"),
        "first_appearance_ids": (lambda s, d: L.first_appearance_ids(_t(s, d, "events"), "user_id", "event_id"), "SELECT user_id, row_number() OVER (ORDER BY MIN(event_id)) - 1 AS id FROM events GROUP BY user_id"),
        "keep_first": (lambda s, d: L.keep_first(_t(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id"), "SELECT user_id, event_type, MIN(event_id) AS event_id FROM events GROUP BY 1, 2"),
        "hin_subset": (_subset, "WITH ap AS (SELECT o_custkey AS a, o_orderkey AS p FROM orders), cp AS (SELECT DISTINCT l_suppkey AS c, l_orderkey AS p FROM lineitem), pt AS (SELECT DISTINCT l_orderkey AS p, l_partkey AS t FROM lineitem), v AS (SELECT c FROM cp GROUP BY c ORDER BY COUNT(*) DESC, c LIMIT 5), a1 AS (SELECT * FROM ap WHERE p IN (SELECT p FROM cp WHERE c IN (SELECT c FROM v))), a2 AS (SELECT * FROM a1 WHERE a IN (SELECT a FROM a1 GROUP BY a HAVING COUNT(*) >= 2)), t1 AS (SELECT * FROM pt WHERE p IN (SELECT p FROM a2)) SELECT t, COUNT(*) AS n FROM t1 GROUP BY t HAVING COUNT(*) >= 2"),
        "tokenize_df": (lambda s, d: T.document_frequency(_t(s, d, "documents"), "text"), f"WITH {_TERMS} SELECT term, df FROM tf"),
        "vocab_ids": (lambda s, d: T.vocabulary(_t(s, d, "documents"), "text"), f"WITH {_TERMS} SELECT term, row_number() OVER (ORDER BY term) AS term_id FROM tf"),
        "doc_term_edges": (lambda s, d: T.document_terms(_t(s, d, "documents"), "doc_id", "text"), f"WITH {_TERMS}, ids AS (SELECT term, row_number() OVER (ORDER BY term) AS term_id FROM tf) SELECT doc_id, term_id FROM w JOIN ids USING (term)"),
        "sanitize": (lambda s, d: _t(s, d, "documents").select("doc_id", T.sanitize(F.col("text")).alias("clean")), r"SELECT doc_id, trim(translate(text, chr(9) || chr(10) || chr(13), '   '), ' ') AS clean FROM documents"),
        "sample_top_users": (lambda s, d: T.sample_top(_t(s, d, "events").select("user_id", "event_id"), "user_id", 20), "SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY COUNT(*) DESC, user_id LIMIT 20)"),
        "sample_uniform": (lambda s, d: T.sample_uniform(_t(s, d, "events").select("user_id", "event_id"), "user_id", 20), None),
        "index_range_check": (lambda s, d: SparseMatrix(sp(s, d).df, 7, 1500).out_of_range(), f"WITH {_SP} SELECT i, j, v FROM sp WHERE i >= 7 OR j >= 1500"),
        "sortedness_check": (lambda s, d: (lambda a: SparseMatrix.unsorted(a.to_csr()).agg(F.count("*").alias("unsorted")).join(a.df.agg(F.count("*").alias("nnz"))))(sp(s, d)), f"WITH {_SP} SELECT CAST(0 AS BIGINT) AS unsorted, COUNT(*) AS nnz FROM sp"),
        "spref_repeats": (lambda s, d: sp(s, d).ref(s.range(0, 60, 3).union(s.range(0, 60, 6)), s.range(0, 1000, 7), "none", repeats=True).df, f"WITH {_SP}, ids AS (SELECT unnest(range(0, 60, 3)) AS i UNION ALL SELECT unnest(range(0, 60, 6))) SELECT i, j, v FROM sp JOIN ids USING (i) WHERE j % 7 = 0 AND j < 1000"),
        "get_flop": (lambda s, d: s.createDataFrame([(P.get_flop(*sq(s, d)),)], "flop long"), f"WITH {_FLOP} SELECT CAST(2 * SUM(flop) AS BIGINT) AS flop FROM fr"),
        "degree_col_filled": (lambda s, d: S.degrees(op(s, d), "j"), f"WITH {_OP}, c AS (SELECT unnest(range(0, (SELECT max(j) + 1 FROM op))) AS j) SELECT c.j, COUNT(op.j) AS degree FROM c LEFT JOIN op USING (j) GROUP BY c.j"),
        "degree_weighted": (lambda s, d: S.degrees(sp(s, d), "j", weighted=True), f"WITH {_SP}, c AS (SELECT unnest(range(0, (SELECT max(j) + 1 FROM sp))) AS j) SELECT c.j, COALESCE(SUM(v), 0.0) AS degree FROM c LEFT JOIN sp USING (j) GROUP BY c.j"),
        "shape_report": (lambda s, d: S.shape_report(sp(s, d)).withColumn("nnz_per_row", F.round("nnz_per_row", 9)), f"WITH {_SP}, rd AS (SELECT COUNT(*) AS n FROM sp GROUP BY i), cd AS (SELECT COUNT(*) AS n FROM sp GROUP BY j) SELECT (SELECT max(i) + 1 FROM sp) AS num_row, (SELECT max(j) + 1 FROM sp) AS num_col, (SELECT COUNT(*) FROM sp) AS nnz, round((SELECT COUNT(*) FROM sp) / CAST((SELECT max(i) + 1 FROM sp) AS DOUBLE), 9) AS nnz_per_row, CAST((SELECT SUM(n * n) FROM cd) AS BIGINT) AS flops_aat, (SELECT MAX(n) FROM rd) AS row_deg_max, (SELECT MAX(n) FROM cd) AS col_deg_max"),
        "greedy_blocks": (lambda s, d: L.greedy_blocks(S.flop_per_row(*sq(s, d)), 8), f"WITH RECURSIVE {_FLOP}, m AS (SELECT CAST(SUM(flop) AS BIGINT) // 8 AS share FROM fr), g AS (SELECT CAST(0 AS BIGINT) AS i, flop, flop AS cur, CAST(0 AS BIGINT) AS block FROM fr WHERE i = 0 UNION ALL SELECT fr.i, fr.flop, CASE WHEN g.cur > m.share THEN fr.flop ELSE g.cur + fr.flop END, g.block + CASE WHEN g.cur > m.share THEN 1 ELSE 0 END FROM g JOIN fr ON fr.i = g.i + 1, m) SELECT i, flop, block FROM g"),
        "analyse": (_analyse, f"WITH {_WORK} {_ANALYSE}"),
        "mtx_round_trip": (_round_trip("mtx"), f"WITH {_SP} SELECT i, j, v FROM sp"),
        "bin_round_trip": (_round_trip("bin"), f"WITH {_SP} SELECT i, j, v FROM sp"),
        "org_trs_pair": (_round_trip("pair"), f"WITH {_SP} SELECT j AS i, i AS j, CAST(1 AS DOUBLE) AS v FROM sp"),
        "edges_round_trip": (_round_trip("edges"), f"WITH {_PP} SELECT i, j, CAST(1 AS DOUBLE) AS v FROM pp UNION ALL SELECT j, i, CAST(1 AS DOUBLE) FROM pp"),
        "dimacs_round_trip": (_dimacs, f"WITH {_SP} SELECT i, j, v FROM sp"),
        "sorted_csv_lines": (_sorted_csv, f"WITH {_SP} SELECT concat(i + 1, ',', j + 1, ',', v) AS line FROM sp UNION ALL SELECT concat(max(i) + 1, ',', max(j) + 1, ',', COUNT(*)) FROM sp"),
        "pairs_round_trip": (_pairs, f"WITH {_OP} SELECT i AS a, j AS b FROM op"),
        "names_round_trip": (_names, f"WITH {_TERMS} SELECT row_number() OVER (ORDER BY term) AS id, term AS name FROM tf"),
        "ratings_round_trip": (_ratings, "SELECT user_id, event_type AS item, COUNT(*) AS rating FROM events GROUP BY 1, 2"),
        "principals_from_gzip": (_principals, "SELECT l_orderkey AS title, l_suppkey AS person FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P'))"),
        "json_fields": (_split_json, "SELECT CAST(doc_id AS VARCHAR) AS id, source AS venue, (SELECT COUNT(*) FROM documents) AS lines FROM documents"),
        "mtx_without_repeats": (_written_once, "SELECT l_suppkey AS i, l_partkey AS j, MIN(l_quantity) AS v FROM lineitem GROUP BY 1, 2"),
        "log_figures": (_log, "SELECT o_orderpriority AS key, concat('order ', o_orderkey) AS value FROM orders"),
        "row_pow2": (lambda s, d: S.flop_per_row(*sq(s, d)).select("i", L.next_pow2(F.col("flop")).alias("size")), f"WITH {_FLOP} SELECT i, CAST(CASE WHEN flop <= 1 THEN 1 ELSE pow(2, ceil(log2(flop))) END AS BIGINT) AS size FROM fr"),
        "hin_from_json": (_json, "WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pid, lang, source FROM documents) SELECT name, doc_id AS id, pid FROM (SELECT DISTINCT doc_id, pid, unnest([lang, source]) AS name FROM x) WHERE name <> ''"),
        "hin_author_ids": (lambda s, d: B.build(papers(s, d)).authors, "WITH x AS (SELECT row_number() OVER (ORDER BY doc_id) AS pid, lang, source FROM documents), w AS (SELECT 2 * pid AS place, lang AS name FROM x UNION ALL SELECT 2 * pid + 1, source FROM x) SELECT row_number() OVER (ORDER BY MIN(place)) AS aid, name FROM w WHERE name <> '' GROUP BY name"),
        "hin_terms": (lambda s, d: B.build(papers(s, d)).pt.groupBy("pid").agg(F.count("*").alias("terms"), F.sum("tid").alias("sum_tid")), f"WITH x AS (SELECT row_number() OVER (ORDER BY doc_id) AS pid, lower(text) AS t FROM documents), w AS MATERIALIZED (SELECT DISTINCT pid, unnest(regexp_extract_all(t, '([a-z]+)', 1)) AS term FROM x), tf AS (SELECT term FROM w WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY term HAVING COUNT(*) >= 2), ids AS (SELECT term, row_number() OVER (ORDER BY term) AS tid FROM tf) SELECT pid, COUNT(*) AS terms, CAST(SUM(tid) AS BIGINT) AS sum_tid FROM w JOIN ids USING (term) GROUP BY pid"),
        "hin_paper_search": (_paper_search, f"WITH x AS (SELECT row_number() OVER (ORDER BY doc_id) AS pid, doc_id, lang, source, lower(text) AS t FROM documents), w AS MATERIALIZED (SELECT DISTINCT pid, unnest(regexp_extract_all(t, '([a-z]+)', 1)) AS term FROM x), tf AS (SELECT term FROM w WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY term HAVING COUNT(*) >= 2), pt AS MATERIALIZED (SELECT pid, term FROM w JOIN tf USING (term)), d AS (SELECT pid, COUNT(*) AS d FROM pt GROUP BY pid), m AS (SELECT q.pid AS query, y.pid AS id, COUNT(*) AS m FROM pt q JOIN pt y USING (term) WHERE q.pid % 20 = 0 GROUP BY 1, 2), r AS (SELECT query, id, 2.0 * m / (a.d + b.d) AS score FROM m JOIN d a ON a.pid = query JOIN d b ON b.pid = id), p AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS place, id, score FROM r) SELECT query, place, id, CAST(doc_id AS VARCHAR) AS name, round(CAST(score AS DOUBLE), 9) AS score FROM p JOIN x ON x.pid = p.id WHERE place <= 5"),
        "hin_author_search": (_author_search, f"WITH x AS (SELECT row_number() OVER (ORDER BY doc_id) AS pid, doc_id, lang, source, lower(text) AS t FROM documents), w AS MATERIALIZED (SELECT DISTINCT pid, unnest(regexp_extract_all(t, '([a-z]+)', 1)) AS term FROM x), tf AS (SELECT term FROM w WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY term HAVING COUNT(*) >= 2), pt AS MATERIALIZED (SELECT pid, term FROM w JOIN tf USING (term)), n AS (SELECT 2 * pid AS place, pid, lang AS name FROM x UNION ALL SELECT 2 * pid + 1, pid, source FROM x), au AS (SELECT row_number() OVER (ORDER BY MIN(place)) AS aid, name FROM n WHERE name <> '' GROUP BY name), ml AS (SELECT aid, term, COUNT(*) AS v FROM (SELECT DISTINCT aid, pid FROM n JOIN au USING (name)) JOIN pt USING (pid) GROUP BY 1, 2), d AS (SELECT aid, SUM(v * v) AS d FROM ml GROUP BY aid), m AS (SELECT a.aid AS query, b.aid AS id, SUM(a.v * b.v) AS m FROM ml a JOIN ml b USING (term) GROUP BY 1, 2), r AS (SELECT query, id, CAST(2 * m AS DOUBLE) / CAST(a.d + b.d AS DOUBLE) AS score FROM m JOIN d a ON a.aid = query JOIN d b ON b.aid = id), p AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS place, id, score FROM r) SELECT query, place, id, name, round(score, 9) AS score FROM p JOIN au ON au.aid = p.id WHERE place <= 3"),
        "hin_subset_matrices": (_subset_matrices, f"WITH x AS (SELECT row_number() OVER (ORDER BY doc_id) AS pid, lang, source, lower(text) AS t FROM documents), v AS (SELECT source FROM x GROUP BY source ORDER BY COUNT(*) DESC, MIN(pid) LIMIT 5), kp AS (SELECT * FROM x WHERE source IN (SELECT source FROM v)), ap AS (SELECT DISTINCT pid, unnest([lang, source]) AS name FROM kp), ka AS (SELECT pid FROM ap WHERE name IN (SELECT name FROM ap GROUP BY name HAVING COUNT(*) >= 2)), w0 AS MATERIALIZED (SELECT DISTINCT pid, unnest(regexp_extract_all(t, '([a-z]+)', 1)) AS term FROM x), tf AS (SELECT term FROM w0 WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY term HAVING COUNT(*) >= 2), w1 AS (SELECT pid, term FROM w0 JOIN tf USING (term) WHERE pid IN (SELECT pid FROM ka)), w AS (SELECT pid, term FROM w1 WHERE term IN (SELECT term FROM w1 GROUP BY term HAVING COUNT(*) >= 3)), ps AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS i FROM (SELECT DISTINCT pid FROM ka)), ts AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS j FROM (SELECT DISTINCT term FROM w)) SELECT i, COUNT(*) AS n, CAST(SUM(j) AS BIGINT) AS terms FROM w JOIN ps USING (pid) JOIN ts USING (term) GROUP BY i"),
        "sort_dedup": (lambda s, d: (lambda r: r[0].withColumn("dropped", F.lit(r[1]).cast("long")))(L.sort_dedup(_t(s, d, "lineitem"), "l_suppkey", "l_partkey")), "SELECT DISTINCT l_suppkey, l_partkey, (SELECT COUNT(*) FROM lineitem) - (SELECT COUNT(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) AS dropped FROM lineitem"),
        "geomean": (lambda s, d: _t(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(S.geomean(F.col("l_quantity")), 6).alias("g")), "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS g FROM lineitem GROUP BY 1"),
    }


def flagship(s: SparkSession, d: str) -> DataFrame:
    return _table()["pathsim_sps_topk"][0](s, d)


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _table().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _table().items() if sql}

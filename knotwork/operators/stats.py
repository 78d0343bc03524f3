"""Work, degree and skew statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..storage import materialize
from .grid import grid_nnz_per_row
from .layout import bin_id, global_rank, magnitude_scan, range_of
from .product import CHUNK, lists, row_blocks, sides


def flop_per_row(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """(i, flop) for all rows of a: rows of the join, without the join."""
    nb = b.df.groupBy(F.col("i").alias("j")).agg(F.count("*").alias("n"))
    work = a.df.join(nb, "j").groupBy("i").agg(F.sum("n").alias("flop"))
    every = a.df.sparkSession.range(a.n_rows).select(F.col("id").alias("i"))
    return every.join(work, "i", "left").select("i", F.coalesce("flop", F.lit(0)).alias("flop"))


def nnz_per_row(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """(i, nnz) of the product's non-empty rows, without a shuffle of its places."""
    return grid_nnz_per_row(a, b).select("i", "nnz")


def nnz_per_row_sketch(a: SparseMatrix, b: SparseMatrix, lg_k: int = 12) -> DataFrame:
    """(i, nnz) of the product's non-empty rows, estimated without making the product:
    one sketch of the columns of each row of b, merged along the rows of a. The work
    is that of a's entries, not of the products. The relative standard error is
    1.04 / sqrt(2^lg_k), 1.6 % by default; few columns are counted exactly. Sketches go to
    blocks of rows, one for each inner id of a block, and are merged there."""
    left, right = sides(a, b, False)
    blocks = row_blocks(left, right)
    rows = right.groupBy("k").agg(F.hll_sketch_agg("j", F.lit(lg_k)).alias("s"))
    held = lists(left.withColumn("cell", range_of("i", blocks.firsts).cast("int")), ["k", "cell"], blocks.widest > CHUNK, ["i"]).join(rows, "k")
    met = held.select("cell", "i", "s").repartitionById(len(blocks.pieces), F.col("cell")).select("cell", "s", F.explode("i").alias("i"))
    return met.groupBy("cell", "i").agg(F.hll_sketch_estimate(F.hll_union_agg("s", F.lit(False))).alias("nnz")).drop("cell")


def compression_factor(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """(i, flop, nnz, cf) for all rows of a; cf is flop / nnz, 0 for empty rows.
    One join gives both numbers: its rows, and its places."""
    row = grid_nnz_per_row(a, b)
    every = a.df.sparkSession.range(a.n_rows).select(F.col("id").alias("i"))
    both = every.join(row, "i", "left").fillna(0, ["flop", "nnz"])
    return both.withColumn("cf", F.coalesce(F.try_divide("flop", "nnz"), F.lit(0.0)))


def matrix_stats(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """One row: shape, entries, product entries, multiplications, their ratio."""
    row = compression_factor(a, b).agg(F.sum("flop").alias("flop"), F.sum("nnz").alias("nnz_c"))
    n = a.df.agg(F.count("*").alias("nnz_a"))
    return row.join(F.broadcast(n)).select(F.lit(a.n_rows).cast("long").alias("n_rows"), F.lit(a.n_cols).cast("long").alias("n_cols"), "nnz_a", "nnz_c", "flop", F.coalesce(F.try_divide("flop", "nnz_c"), F.lit(0.0)).alias("flop_per_nnz"))


def bound_check(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """One row: rows whose bound min(flop, columns) is above, and below, the truth."""
    bound = F.least("flop", F.lit(b.n_cols))
    return compression_factor(a, b).agg(F.count_if(bound > F.col("nnz")).alias("over"), F.count_if(bound < F.col("nnz")).alias("under"))


def part_factors(parts: DataFrame) -> DataFrame:
    """parts(part, flop, nnz_in, nnz_out) added up, with flop / input and flop / output."""
    s = parts.groupBy("part").agg(F.sum("flop").alias("flop"), F.sum("nnz_in").alias("nnz_in"), F.sum("nnz_out").alias("nnz_out"))
    return s.withColumn("cfi", F.coalesce(F.try_divide("flop", "nnz_in"), F.lit(0.0))).withColumn("cfo", F.coalesce(F.try_divide("flop", "nnz_out"), F.lit(0.0)))


def row_bins(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    return flop_per_row(a, b).withColumn("bin", bin_id(F.col("flop"), b.n_cols))


def max_row_nnz(a: SparseMatrix) -> DataFrame:
    return a.df.groupBy("i").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_nnz"))


def row_hotness(a: SparseMatrix, b: SparseMatrix, threshold: float = 1e-4) -> DataFrame:
    """(k, refs, freq, nnz) of b's rows that a refers to with more than the
    share threshold of its entries; order by freq, then nnz, descending."""
    n = a.df.agg(F.count("*").alias("total"))
    refs = a.df.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("refs")).join(F.broadcast(n))
    hot = refs.withColumn("freq", F.col("refs") / F.col("total")).where(F.col("freq") > threshold)
    own = b.df.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("nnz"))
    return hot.join(own, "k", "left").select("k", "refs", "freq", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def by_hotness(a: SparseMatrix, b: SparseMatrix, threshold: float = 1e-4) -> DataFrame:
    """row_hotness() in its order: the most referred to first, then the longest."""
    return row_hotness(a, b, threshold).orderBy(F.desc("freq"), F.desc("nnz"), "k")


def degrees(a: SparseMatrix, axis: str = "i", weighted: bool = False) -> DataFrame:
    """(axis, degree) for all rows (or columns), 0 where nothing is; weighted adds values."""
    size = a.n_rows if axis == "i" else a.n_cols
    every = a.df.sparkSession.range(size).select(F.col("id").alias(axis))
    own = a.df.groupBy(axis).agg((F.sum("v") if weighted else F.count("*")).alias("degree"))
    return every.join(own, axis, "left").fillna(0, ["degree"])


def shape_report(a: SparseMatrix) -> DataFrame:
    """One row: shape, entries, entries for each row, multiplications of a times its
    transpose, largest degrees."""
    rows = a.df.groupBy("i").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"), F.coalesce(F.max("n"), F.lit(0)).alias("row_deg_max"))
    cols = a.df.groupBy("j").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("flops_aat"), F.coalesce(F.max("n"), F.lit(0)).alias("col_deg_max"))
    shape = [F.lit(n).cast("long").alias(k) for n, k in ((a.n_rows, "num_row"), (a.n_cols, "num_col"))]
    per_row = F.coalesce(F.try_divide("nnz", F.lit(a.n_rows)), F.lit(0.0))
    return rows.join(F.broadcast(cols)).select(*shape, "nnz", per_row.alias("nnz_per_row"), "flops_aat", "row_deg_max", "col_deg_max")


def geomean(value: Column) -> Column:
    return F.exp(F.avg(F.log(value)))


# concentration of work(i, x)
def _skew(work: DataFrame, x: str, heads: tuple[float, ...], masses: tuple[float, ...], held: bool = False) -> DataFrame:
    """One row: n, total, max, mean, nonzero, crossover, row_frac, gini, mass_frac (of the
    crossover's rows, if held), and arrays share (mass of the largest rows, by heads) and rows (share of rows
    for a mass, by masses). Computed on the histogram of x, in ranges of it."""
    hist = work.groupBy(F.col(x).alias("x")).agg(F.count("*").alias("n"))
    h = magnitude_scan(hist, "x", True, rows_before=F.col("n"), sum_before=F.col("x") * F.col("n"))
    # from the histogram as well, so that work is looked at once
    s = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("x") * F.col("n")), F.lit(0)).alias("total"), F.max("x").alias("largest"), F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("n")).otherwise(0)), F.lit(0)).alias("nonzero"))
    h = h.join(F.broadcast(s))

    def prefixes(limit: Column, strict: bool) -> Column:
        """Rows whose sum up to and with them is at most (below) the limit."""
        room = (limit - F.col("sum_before")) / F.when(F.col("x") > 0, F.col("x"))
        whole = (F.ceil(room) - 1) if strict else F.floor(room)
        inside = F.when(F.col("x") > 0, whole).otherwise(F.when(F.col("sum_before") < limit if strict else F.col("sum_before") <= limit, F.col("n")).otherwise(0))
        return F.coalesce(F.sum(F.least(F.col("n"), F.greatest(F.lit(0), inside))), F.lit(0))

    def first_rows(k: Column) -> Column:
        """Sum of the k largest rows."""
        return F.coalesce(F.sum(F.greatest(F.lit(0), F.least(F.col("n"), k - F.col("rows_before"))) * F.col("x")), F.lit(0))

    total = F.col("total").cast("double")
    rank_sum = F.col("n") * (F.col("n_rows") - F.col("rows_before")) - F.col("n") * (F.col("n") - 1) / 2  # of ascending places
    got = h.agg(
        prefixes(total / 2, False).alias("half"), F.coalesce(F.sum(rank_sum * F.col("x")), F.lit(0.0)).alias("weighted"),
        F.array(*(first_rows(F.greatest(F.lit(1), F.bround(F.col("n_rows") * f)).cast("long")) for f in heads)).alias("tops"),
        F.array(*(prefixes(total * m, True) for m in masses)).alias("parts"),
    )
    got = s.join(F.broadcast(got))
    some = F.col("total") > 0
    k = F.least(F.col("half") + 1, F.col("n_rows"))
    got = got.select(
        F.col("n_rows").alias("n"), "total", F.coalesce("largest", F.lit(0)).alias("max"), F.coalesce(F.try_divide("total", "n_rows"), F.lit(0.0)).alias("mean"), "nonzero",
        F.when(some, k).cast("long").alias("crossover"), F.when(some, k / F.col("n_rows")).alias("row_frac"),
        F.when(some, F.transform("tops", lambda t: t / F.col("total"))).otherwise(F.array(*(F.lit(0.0) for _ in heads))).alias("share"),
        F.when(some, F.transform("parts", lambda p: F.least(p + 1, F.col("n_rows")) / F.col("n_rows"))).otherwise(F.array(*(F.lit(0.0) for _ in masses))).alias("rows"),
        F.when(some, 2 * F.col("weighted") / (F.col("n_rows") * F.col("total")) - (F.col("n_rows") + 1) / F.col("n_rows")).otherwise(0.0).alias("gini"),
    )
    if not held:
        return got
    # what the crossover's rows hold
    return got.join(F.broadcast(h.join(F.broadcast(got.select("crossover"))).agg(first_rows(F.col("crossover")).alias("_held")))).withColumn("mass_frac", F.when(F.col("crossover").isNotNull(), F.col("_held") / F.col("total"))).drop("_held")


def concentration(work: DataFrame, x: str = "flop", top: float = 0.1, mass: float = 0.5, threads: int = 64) -> DataFrame:
    """One row about how unevenly x is spread over rows.

    n, total, max, mean, nonzero; crossover (least number of largest rows with
    more than half, null if nothing); mass_at_top (share of the largest
    max(1, round(n * top)) rows); rows_for_mass (least share of rows with the
    mass); gini; hot (largest row against a fair share of threads);
    thread_rows (share of rows with 1 / threads of all). All but the crossover
    are 0 if there is nothing.
    """
    got = _skew(work, x, (top,), (mass, 1.0 / threads))
    hot = F.when(F.col("total") > 0, F.col("max") / (F.col("total") / threads)).otherwise(0.0)
    return got.select("n", "total", "max", "mean", "nonzero", "crossover", F.col("share")[0].alias("mass_at_top"), F.col("rows")[0].alias("rows_for_mass"), "gini", hot.alias("hot"), F.col("rows")[1].alias("thread_rows"))


#: Head shares and masses that analyse() reports.
HEADS, MASSES = (0.001, 0.01, 0.05, 0.1, 0.2), (0.5, 0.8, 0.9, 0.99)


def analyse(work: DataFrame, x: str = "flop", threads: int = 64, heads: tuple[float, ...] = HEADS, masses: tuple[float, ...] = MASSES) -> DataFrame:
    """One row with all of it: n, sum, max, mean, nonzero, gini, crossover_k (0 if
    there is nothing) with its shares of rows and mass, top{f}pct_share for each
    head, rows_for_{m}pct for each mass, the bound by threads, and the power
    law's alpha, alpha_xmin, alpha_ks and alpha_ntail (null without a fit)."""
    got = _skew(work, x, heads, (*masses, 1.0 / threads), held=True)
    some = F.col("total") > 0
    fit = powerlaw_fit(work, x) or {}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return got.select(
        "n", F.col("total").cast("double").alias("sum"), "max", "mean", "nonzero", "gini", F.coalesce("crossover", F.lit(0)).alias("crossover_k"),
        zero("row_frac").alias("crossover_row_frac"), zero("mass_frac").alias("crossover_mass_frac"),
        *(F.col("share")[k].alias(f"top{f * 100:g}pct_share".replace(".", "_")) for k, f in enumerate(heads)),
        *(F.col("rows")[k].alias(f"rows_for_{int(m * 100)}pct") for k, m in enumerate(masses)),
        F.when(some, F.col("total") / threads).otherwise(0.0).alias("thread_fair_share"), F.when(some, F.col("max") / (F.col("total") / threads)).otherwise(0.0).alias("hot_row_vs_thread"),
        F.col("rows")[len(masses)].alias("rows_for_one_thread"),
        *(F.lit(fit.get(k)).cast("long" if k == "tail" else "double").alias(name) for k, name in (("alpha", "alpha"), ("xmin", "alpha_xmin"), ("ks", "alpha_ks"), ("tail", "alpha_ntail"))),
    )


def heaviest_rows(work: DataFrame, k: int, x: str = "flop") -> DataFrame:
    """(i, x, share) of the k heaviest rows, ties to the smaller id."""
    total = work.agg(F.sum(x).alias("total"))
    return work.join(F.broadcast(total)).select("i", x, F.coalesce(F.try_divide(x, "total"), F.lit(0.0)).alias("share")).orderBy(F.desc(x), "i").limit(k)


def powerlaw_fit(work: DataFrame, x: str = "flop", candidates: int = 200, least_tail: int = 50) -> dict[str, float] | None:
    """{alpha, xmin, ks, tail} of the power law whose tail fits best, or None.

    Candidates for xmin are the distinct positive values, or if there are more,
    evenly spaced percentiles of these up to the 95th; those below 1 are left
    out. alpha = 1 + n / sum ln(x / (xmin - 0.5)) over the n >= least_tail rows
    from xmin on, and the model is 1 - (x / xmin)^(1 - alpha). The smallest
    Kolmogorov distance wins, of equal ones the smallest xmin. It is taken at the
    first and the last of equal values. Everything comes from the histogram and
    its sums in ranges; the driver sees at most ``candidates`` values.
    """
    pos = work.where(F.col(x) > 0).select(F.col(x).cast("double").alias("x"))
    hist = materialize(magnitude_scan(pos.groupBy("x").agg(F.count("*").alias("n")), "x", True, above=F.col("n")))
    if hist.limit(candidates + 1).count() > candidates:
        marks = hist.agg(F.percentile("x", [0.95 * k / (candidates - 1) for k in range(candidates)])).first()[0]
    else:
        marks = [r[0] for r in hist.select("x").collect()]
    marks = sorted({float(m) for m in marks if m >= 1})
    if not marks:
        return None
    spark = work.sparkSession
    # candidates are few, so a row of the histogram meets at most so many of them, and is added up at once
    meet = lambda c: hist.join(F.broadcast(c), F.col("x") >= F.col("xmin"))
    sums = meet(spark.createDataFrame([(m,) for m in marks], "xmin double")).groupBy("xmin").agg(F.sum("n").alias("tail"), F.sum(F.col("n") * F.log(F.col("x") / (F.col("xmin") - 0.5))).alias("logs"))
    fits = [(r["xmin"], 1 + r["tail"] / r["logs"], r["tail"]) for r in sums.collect() if r["tail"] >= least_tail and r["logs"] > 0]
    fits = [f for f in fits if f[1] > 1]
    if not fits:
        return None
    last = F.col("tail") - F.col("above")
    model = 1 - F.pow(F.col("x") / F.col("xmin"), 1 - F.col("alpha"))
    gap = F.greatest(F.abs(last / F.col("tail") - model), F.abs((last - F.col("n") + 1) / F.col("tail") - model))
    best = meet(spark.createDataFrame(fits, "xmin double, alpha double, tail long")).groupBy("xmin", "alpha", "tail").agg(F.max(gap).alias("ks")).orderBy("ks", "xmin").first()
    return {k: best[k] for k in ("alpha", "xmin", "ks", "tail")}


def degree_ranks(a: SparseMatrix) -> DataFrame:
    """(i, degree, rank) over all vertices, degree 0 included: ascending
    degree, then id."""
    n = max(a.n_rows, a.n_cols)
    every = a.df.sparkSession.range(n).select(F.col("id").alias("i"))
    deg = every.join(a.df.groupBy("i").agg(F.count("*").alias("degree")), "i", "left").fillna(0, ["degree"])
    return global_rank(deg, [F.col("degree"), F.col("i")], "rank")

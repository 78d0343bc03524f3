"""Products over a grid of row and column blocks.

The entries of a are dealt by blocks of rows and those of b by blocks of columns.
Cell (r, c) of the grid gets a's block r and b's block c, so an entry is copied
along its row or column of cells, and all products of a place (i, j) are made in
one cell: they are joined and added up where they are, and no product is
shuffled, however many there are. A cell is one partition; both sides are dealt
by its number, which the join and the aggregation then ask for, so their plan has
the two exchanges of the entries and no other.

Blocks are hashes of the ids, or ranges of about equal work, which is known from
degrees alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..storage import materialize
from .layout import balanced_ranges, range_of
from .product import SMALL, added, met, mirrored, products, row_blocks, sides, times


#: Inner ids of all sets in a cell of overlap_search, at most about, and the least that make a cell worth while.
BLOCK, LEAST_BLOCK = 1 << 21, 1 << 15


def hashed(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def shape_of(cells: int, left: int = 1, right: int = 1) -> tuple[int, int]:
    """Rows and columns of a grid of about so many cells for which the copies of
    ``left`` entries, one for each column, and ``right`` ones are fewest."""
    rows = min(cells, max(1, round(math.sqrt(cells * left / max(1, right)))))
    return rows, max(1, cells // rows)


def dealt(entries: DataFrame, block: Column, others: int, cell: Callable[[Column, Column], Column], cells: DataFrame | None, side: str, n: int) -> DataFrame:
    """entries once for each cell of their block, in that cell's partition: all
    ``others`` blocks of the other side, or those that cells(r, c) names."""
    own, other = ("r", "c") if side == "left" else ("c", "r")
    if cells is None:
        copies = entries.withColumn("_own", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    else:
        # a row for each pair of blocks
        named = F.broadcast(cells.groupBy(F.col(own).alias("_own")).agg(F.collect_set(other).alias("_others")))
        copies = entries.withColumn("_own", block).join(named, "_own").withColumn("_other", F.explode("_others")).drop("_others")
    at = cell(F.col("_own"), F.col("_other")) if side == "left" else cell(F.col("_other"), F.col("_own"))
    return copies.withColumn("cell", at.cast("int")).drop("_own", "_other").repartitionById(n, F.col("cell"))


def grid_join(a: DataFrame, b: DataFrame, row: Column, col: Column, rows: int, cols: int, cells: DataFrame | None = None) -> DataFrame:
    """(cell, i, j, x, y): the products of a(i, k, x) and b(k, j, y) in the cells of a
    grid of rows x cols blocks (of all, or of cells(r, c)), partitioned by cell."""
    number = lambda r, c: r * cols + c
    left = dealt(a, row, cols, number, cells, "left", rows * cols)
    right = dealt(b, col, rows, number, cells, "right", rows * cols)
    return left.join(right.hint("shuffle_hash"), ["cell", "k"]).select("cell", "i", "j", "x", "y")


def _sides(a: SparseMatrix, b: SparseMatrix) -> tuple[DataFrame, DataFrame]:
    if a.cols is not b.rows and a.n_cols != b.n_rows:
        raise ValueError(f"shapes {a.n_rows}x{a.n_cols} and {b.n_rows}x{b.n_cols} don't fit")
    return a.df.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))


def grid_spgemm(a: SparseMatrix, b: SparseMatrix, rows: int | None = None, cols: int | None = None, mul: Callable = times, add: Callable = F.sum) -> SparseMatrix:
    """a * b over a semiring, aggregated in the cells of a grid. Without a shape its
    cells are blocks of rows with equal work, and entries go only where their inner id
    is; a product of a single block is made in a square grid instead."""
    if not rows or not cols:
        own, other = sides(a, b)
        blocks = row_blocks(own, other)
        if sum(blocks.pieces) > 1:
            return SparseMatrix(added(met(own, other, blocks), mul, add), a.rows, b.cols)
        rows, cols = shape_of(2 * int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = _sides(a, b)
    both = grid_join(left, right, hashed("i", rows), hashed("j", cols), rows, cols)
    return SparseMatrix(both.groupBy("cell", "i", "j").agg(add(mul(F.col("x"), F.col("y"))).cast("double").alias("v")).drop("cell"), a.rows, b.cols)


def _places(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """(cell, i, j, n): the places of a * b with their products, in blocks of rows."""
    return products(a, b, False).groupBy("cell", "i", "j").agg(F.count("*").alias("n"))


def grid_project(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """(cell, i, j): the distinct places that the join of a and b reaches, each in one
    cell. An aggregation by i takes a row for each cell and i."""
    return _places(a, b).select("cell", "i", "j")


def grid_nnz_per_row(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """(i, flop, nnz) of the product's non-empty rows, counted where the places are."""
    return _places(a, b).groupBy("cell", "i").agg(F.sum("n").alias("flop"), F.count("*").alias("nnz")).groupBy("i").agg(F.sum("flop").alias("flop"), F.sum("nnz").alias("nnz"))


def grid_gram(a: SparseMatrix, upper_only: bool = False, blocks: int | None = None, mul: Callable = times, add: Callable = F.sum) -> SparseMatrix:
    """a * transpose(a) for a mul that doesn't care for sides, in the cells of blocks
    r <= c: half of the products, mirrored where they are made unless upper_only. Without
    a number of blocks the cells are blocks of rows, and places of i > j aren't kept."""
    if not blocks:
        df = added(products(a, a.transpose()).where("i <= j"), mul, add)
        return SparseMatrix(df if upper_only else mirrored(df), a.rows, a.rows)
    left, right = _sides(a, a.transpose())
    n = blocks
    cells = n * (n + 1) // 2
    own = left.withColumn("_own", hashed("i", n)).withColumn("_other", F.explode(F.sequence("_own", F.lit(n - 1))))
    own = own.select((F.col("_other") * (F.col("_other") + 1) / 2 + F.col("_own")).cast("int").alias("cell"), "i", "k", "x")
    other = right.withColumn("_own", hashed("j", n)).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_own"))))
    other = other.select((F.col("_own") * (F.col("_own") + 1) / 2 + F.col("_other")).cast("int").alias("cell"), "k", "j", "y")
    both = own.repartitionById(cells, F.col("cell")).join(other.repartitionById(cells, F.col("cell")).hint("shuffle_hash"), ["cell", "k"])
    # in a cell of one block each pair comes from both sides
    single = F.array(*(F.lit(k in {c * (c + 1) // 2 + c for c in range(n)}) for k in range(cells)))
    both = both.where(~F.get(single, F.col("cell")) | (F.col("i") <= F.col("j")))
    df = both.groupBy("cell", "i", "j").agg(add(mul(F.col("x"), F.col("y"))).cast("double").alias("v"))
    if upper_only:
        df = df.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v")
    else:
        df = mirrored(df)
    return SparseMatrix(df, a.rows, a.rows)


def work_ranges(entries: DataFrame, own: str, inner: str, weight: DataFrame, parts: int) -> list[int]:
    """First ids of at most ``parts`` ranges of ``own`` of about equal work: each entry
    weighs as many products as weight(inner, n) says. An id heavier than a range
    is a range of its own."""
    work = entries.join(weight, inner).groupBy(F.col(own).alias("i")).agg(F.sum("n").alias("flop"))
    got = balanced_ranges(work, parts).groupBy("part").agg(F.min("i").alias("first")).orderBy("first").collect()
    return [r["first"] for r in got]


def needed(entries: DataFrame, block: Column, others: DataFrame, other_block: Column) -> DataFrame:
    """entries(k, ...) once for each block of the other side that has k, as _own and _other."""
    met = others.select("k", other_block.alias("_other")).groupBy("k").agg(F.collect_set("_other").alias("_others"))
    return entries.withColumn("_own", block).join(met, "k").withColumn("_other", F.explode("_others")).drop("_others")


def balanced_spgemm(a: SparseMatrix, b: SparseMatrix, rows: int | None = None, cols: int | None = None, mul: Callable = times, add: Callable = F.sum) -> SparseMatrix:
    """a * b in the cells of a grid whose blocks are ranges of rows of a and of
    columns of b of about equal work, from degrees alone: a row's work is the sum
    of the sizes of b's rows that it meets, a column's that of a's columns. A row
    that is heavier than a block is split over the columns of the grid, and a
    column over its rows, so what one cell can't share is a single place. An entry
    is copied only to blocks of the other side that have its inner id, so where ids
    that meet are near each other most entries are sent once or twice. Without a shape
    only rows have blocks, and a heavy row is split over columns."""
    if not rows or not cols:
        return SparseMatrix(added(products(a, b), mul, add), a.rows, b.cols)
    left, right = _sides(a, b)
    size = lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    by_row, by_col = work_ranges(left, "i", "k", size(right), rows), work_ranges(right, "j", "k", size(left), cols)
    r, c, cells = range_of("i", by_row), range_of("j", by_col), max(1, len(by_row)) * max(1, len(by_col))
    own = needed(left, r, right, c).withColumn("cell", (F.col("_own") * max(1, len(by_col)) + F.col("_other")).cast("int"))
    other = needed(right, c, left, r).withColumn("cell", (F.col("_other") * max(1, len(by_col)) + F.col("_own")).cast("int"))
    own, other = own.select("cell", "i", "k", "x").repartitionById(cells, F.col("cell")), other.select("cell", "k", "j", "y").repartitionById(cells, F.col("cell"))
    both = own.join(other.hint("shuffle_hash"), ["cell", "k"])
    return SparseMatrix(both.groupBy("cell", "i", "j").agg(add(mul(F.col("x"), F.col("y"))).cast("double").alias("v")).drop("cell"), a.rows, b.cols)


def cell_work(a: SparseMatrix, b: SparseMatrix, rows: int, cols: int) -> DataFrame:
    """(cell, flop) of the cells that balanced_spgemm makes, from counts of entries."""
    left, right = _sides(a, b)
    size = lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    by_row, by_col = work_ranges(left, "i", "k", size(right), rows), work_ranges(right, "j", "k", size(left), cols)
    x = left.groupBy("k", range_of("i", by_row).alias("r")).agg(F.count("*").alias("nx"))
    y = right.groupBy("k", range_of("j", by_col).alias("c")).agg(F.count("*").alias("ny"))
    return x.join(y, "k").groupBy((F.col("r") * max(1, len(by_col)) + F.col("c")).cast("long").alias("cell")).agg(F.sum(F.col("nx") * F.col("ny")).alias("flop"))


def _norm_blocks(norms: DataFrame, blocks: int) -> list[float]:
    """Lower ends of at most ``blocks`` ranges of norms (descending numbers of rows alike)."""
    cuts = norms.select(F.percentile_approx("d", [k / blocks for k in range(blocks)], 10_000)).first()[0]
    return sorted(set(cuts or []))


def _best_of_cells(both: DataFrame, k: int, mirrored: bool) -> DataFrame:
    """(i, j, score): of each cell's products (cell, i, j, x, y), with x and y of a value
    v and a row's square sum d, the k best of each i; mirrored: of each j, too. All of
    it happens in the cell's partition."""
    m = both.groupBy("cell", "i", "j").agg(F.sum(F.col("x.v") * F.col("y.v")).alias("m"), F.first(F.col("x.d") + F.col("y.d")).alias("dd"))
    score = (2 * F.col("m") / F.when(F.col("dd") != 0, F.col("dd"))).alias("score")
    if mirrored:
        m = m.select("cell", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), "m", "dd").select("cell", "p.*", "m", "dd")
    w = Window.partitionBy("cell", "i").orderBy(F.desc("score"), "j")
    return m.select("cell", "i", "j", score).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("i", "j", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("i").orderBy(F.desc("score"), "j")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def pathsim_search(ml: SparseMatrix, queries: DataFrame, k: int, names: DataFrame | None = None) -> DataFrame:
    """(query, place, id, score): the k nodes most similar to each of queries(id), itself
    included, by 2 M[q, y] / (M[q, q] + M[y, y]) with M = ml * transpose(ml), of which
    only the rows of the queries and the diagonal are made. Ties to the smaller id;
    places count from 1. names(id, name) adds the names of id.

    The queries' entries are the rows of a grid and all entries its columns, so
    scores are made and cut to the k best where the entries meet.
    """
    spark = ml.df.sparkSession
    norms = ml.df.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("d"))
    entries = materialize(ml.df.join(norms, "i").select("i", F.col("j").alias("k"), F.struct("v", "d").alias("x")))
    asked = entries.join(queries.select(F.col("id").alias("i")).distinct(), "i", "left_semi")
    few, all_ = (df.count() for df in (asked, entries))
    rows, cols = shape_of(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), few, all_)
    both = grid_join(asked, entries.select("k", F.col("i").alias("j"), F.col("x").alias("y")), hashed("i", rows), hashed("j", cols), rows, cols)
    got = _top(_best_of_cells(both, k, False), k).select(F.col("i").alias("query"), "place", F.col("j").alias("id"), "score")
    return got.join(names.select("id", "name"), "id", "left").select("query", "place", "id", "name", "score") if names is not None else got


def overlap_search(ml: SparseMatrix, queries: DataFrame, k: int, names: DataFrame | None = None) -> DataFrame:
    """pathsim_search for a matrix whose entries are all 1 and don't repeat: rows are sets of
    inner ids, and M[q, y] counts those of both.

    Queries and all sets are dealt to the cells of a grid, a row for each set. A cell lists the
    places of its sets by inner id, and for each query counts the places in its ids' lists, so
    all pairs that share an id are counted and none becomes a row but the k best.
    """
    sets = materialize(ml.df.groupBy("i").agg(F.collect_list("j").alias("ks")))
    asked = sets.join(queries.select(F.col("id").alias("i")).distinct(), "i", "left_semi")
    few, all_ = (df.agg(F.coalesce(F.sum(F.size("ks")), F.lit(0))).first()[0] for df in (asked, sets))
    rows, cols = max(1, -(-few // BLOCK)), max(1, -(-all_ // BLOCK))
    cols = max(cols, min(-(-2 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")) // rows), all_ // LEAST_BLOCK))
    left = asked.withColumn("_own", hashed("i", rows)).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).select((F.col("_own") * cols + F.col("_other")).cast("int").alias("cell"), F.lit(True).alias("asks"), "i", "ks")
    right = sets.withColumn("_own", hashed("i", cols)).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).select((F.col("_other") * cols + F.col("_own")).cast("int").alias("cell"), F.lit(False).alias("asks"), "i", "ks")

    def best(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        for cell in np.unique(table["cell"].to_numpy()) if table is not None else ():
            here = table.filter(pa.array(table["cell"].to_numpy() == cell))
            mark = here["asks"].to_numpy()
            query, own = here.filter(pa.array(mark)), here.filter(pa.array(~mark)).sort_by("i")
            ids, sizes = own["i"].to_numpy(), own["ks"].combine_chunks().value_lengths().to_numpy().astype("int64")
            inner = own["ks"].combine_chunks().flatten().to_numpy()
            order = np.argsort(inner, kind="stable")
            places, inner = np.repeat(np.arange(len(ids)), sizes)[order], inner[order]
            found = []
            asked_ids, lists = query["i"].to_numpy(), query["ks"].combine_chunks()
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            wanted = lists.flatten().to_numpy()
            lows, highs = np.searchsorted(inner, wanted, "left"), np.searchsorted(inner, wanted, "right")
            for q, a, b in zip(asked_ids, ends, ends[1:], strict=False):
                n = np.bincount(np.concatenate([places[x:y] for x, y in zip(lows[a:b], highs[a:b], strict=True)]), minlength=len(ids))
                score = 2.0 * n / (float(b - a) + sizes)
                least = np.partition(score, -k)[-k] if len(score) > k else 0.0
                at = np.flatnonzero((score >= least) & (n > 0))
                at = at[np.lexsort((at, -score[at]))[:k]]  # places go by id
                found.append((np.full(len(at), q), ids[at], score[at]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["i", "j", "score"])

    both = left.unionByName(right).repartitionById(rows * cols, F.col("cell"))
    got = _top(both.mapInArrow(best, "i long, j long, score double"), k).select(F.col("i").alias("query"), "place", F.col("j").alias("id"), "score")
    return got.join(names.select("id", "name"), "id", "left").select("query", "place", "id", "name", "score") if names is not None else got


def pathsim_all(ml: SparseMatrix, k: int, blocks: int | None = None) -> DataFrame:
    """(i, j, score): the k most similar others of every node by 2 M[i, j] / (M[i, i] +
    M[j, j]) with M = ml * transpose(ml). Ties to the smaller id; entries without
    a value add nothing, and a pair that shares only such has no score.

    M[i, j] is at most the product of the norms p, q of the two rows, so a score is
    at most 2 p q / (p^2 + q^2): less, the more the norms differ. Rows are blocks by
    norm. The cells of like norms are made first; where every row of a block has k
    others as good as another block's bound, that cell is skipped.
    """
    return _pathsim_cells(ml, k, blocks)[0]


def _pathsim_cells(ml: SparseMatrix, k: int, blocks: int | None = None) -> tuple[DataFrame, int, int]:
    """pathsim_all, and how many cells were made of how many."""
    spark = ml.df.sparkSession
    blocks = blocks or shape_of(2 * int(spark.conf.get("spark.sql.shuffle.partitions")))[0]
    held = ml.df.where("i is not null")
    norms = materialize(held.groupBy("i").agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("d")))
    lows = _norm_blocks(norms, blocks) or [0.0]
    n = len(lows)
    block = F.lit(-1)
    for low in lows:
        block = block + (F.col("d") >= low).cast("int")
    block = F.greatest(block, F.lit(0))
    norms = norms.withColumn("b", block)
    ends = {r["b"]: (r["lo"], r["hi"]) for r in norms.groupBy("b").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect()}
    # each entry knows its row's block and norm; a row for each node is joined or broadcast
    own = F.broadcast(norms) if norms.limit(SMALL + 1).count() <= SMALL else norms
    # written once, since both passes deal them, and M is symmetric: cells of blocks r <= c are enough
    entries = materialize(held.where("j is not null").join(own, "i").select("i", F.col("j").alias("k"), "v", "d", "b"))
    left = entries.select("i", "k", F.struct("v", "d").alias("x"), F.col("b").alias("_r"))
    right = entries.select("k", F.col("i").alias("j"), F.struct("v", "d").alias("y"), F.col("b").alias("_c"))

    def best(cells: list[tuple[int, int]]) -> DataFrame:
        named = spark.createDataFrame(cells, "r int, c int")
        both = grid_join(left, right, F.col("_r"), F.col("_c"), n, n, named).where((F.col("cell") % (n + 1) != 0) | (F.col("i") < F.col("j")))
        return materialize(_best_of_cells(both, k, True))

    near = [(r, c) for r in ends for c in ends if r <= c <= r + 1]
    got = best(near)
    kth = got.groupBy("i").agg(F.count("score").alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    kth = norms.select("i", "b").join(kth, "i", "left").select("b", F.when(F.col("n") >= k, F.get("s", F.lit(k - 1))).otherwise(-1.0).alias("least"))
    least = {r["b"]: r["least"] for r in kth.groupBy("b").agg(F.min("least").alias("least")).collect()}

    def bound(r: int, c: int) -> float:
        (lo, hi), (lo2, hi2) = ends[r], ends[c]
        if lo <= hi2 and lo2 <= hi:
            return 1.0
        small, large = (math.sqrt(hi), math.sqrt(lo2)) if hi < lo2 else (math.sqrt(hi2), math.sqrt(lo))
        return 2 * small * large / (small**2 + large**2) * (1 + 1e-9) if large else 1.0

    far = [(r, c) for r in ends for c in ends if c > r + 1 and bound(r, c) >= min(least[r], least[c])]
    if far:
        got = got.unionByName(best(far))
    return _top(got, k).drop("place"), len(near) + len(far), len(ends) * (len(ends) + 1) // 2

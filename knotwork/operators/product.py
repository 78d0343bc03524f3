"""Products of sparse matrices as join and aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..storage import materialize
from .layout import balanced_ranges, range_of

#: Products of a block of rows, the least that make a block worth while, and entries of an inner id that travel in one row.
SHARE, LEAST, CHUNK = 1 << 23, 1 << 20, 1 << 14
#: Vectors and dense operands with at most this many rows are broadcast, and places of a product that a task makes of rows that are alike.
SMALL, TASK = 1_000_000, 1 << 23
#: Columns of a tile of such places: so few that a page of a file repeats them often.
WIDTH = 256


def times(x: Column, y: Column) -> Column:
    return x * y


def plus(x: Column, y: Column) -> Column:
    return x + y


def flop_total(a: SparseMatrix, b: SparseMatrix) -> int:
    """Rows of the join behind a * b, from degrees alone."""
    da = a.df.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("x"))
    db = b.df.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("y"))
    return da.join(db, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0))).first()[0]


#: Multiplications from which a guarded product is refused.
MOST_FLOP = 200_000_000


def guard_flop(a: SparseMatrix, b: SparseMatrix, most: int = MOST_FLOP) -> int:
    n = flop_total(a, b)
    if n > most:
        raise ValueError(f"the product takes {n} multiplications; the limit is {most}")
    return n


def get_flop(a: SparseMatrix, b: SparseMatrix) -> int:
    """Multiplications and additions: twice the rows of the join."""
    return 2 * flop_total(a, b)


def sides(a: SparseMatrix, b: SparseMatrix, values: bool = True) -> tuple[DataFrame, DataFrame]:
    """(i, k, x) and (j, k, y) of the entries of a and b, dealt by k; without x and y
    unless values. Where b is a's transpose both are the same exchange."""
    # the same extent, known or not, always fits
    if a.cols is not b.rows and a.n_cols != b.n_rows:
        raise ValueError(f"shapes {a.n_rows}x{a.n_cols} and {b.n_rows}x{b.n_cols} don't fit")
    left = a.df.select("i", F.col("j").alias("k"), *([F.col("v").alias("x")] if values else []))
    right = b.df.select("j", F.col("i").alias("k"), *([F.col("v").alias("y")] if values else []))
    return left.repartition("k"), right.repartition("k")


@dataclass(frozen=True)
class Blocks:
    """Ranges of rows by their first ids, the cells of each, and the sizes that tell whether lists have to be cut."""

    firsts: list[int]
    pieces: list[int]
    widest: int
    longest: int


def row_blocks(left: DataFrame, right: DataFrame) -> Blocks:
    """Ranges of rows with about equal work, from degrees alone: SHARE products each, or less
    where that gives fewer blocks than shuffle partitions. A block that a heavy row
    makes larger is split over columns."""
    sizes = right.groupBy("k").agg(F.count("*").alias("n"))
    return blocks_of(materialize(left.join(sizes, "k").groupBy("i").agg(F.sum("n").alias("flop"), F.max("n").alias("most"))))


def blocks_of(work: DataFrame) -> Blocks:
    """The blocks of work(i, flop, most): a row's products, and the most of an entry."""
    total, longest, rows = work.agg(F.coalesce(F.sum("flop"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-total // SHARE), min(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LEAST))
    if parts == 1:
        return Blocks([], [1], rows, longest)
    got = balanced_ranges(work.select("i", "flop"), parts).groupBy("part").agg(F.min("i").alias("first"), F.sum("flop").alias("flop"), F.count("*").alias("rows")).orderBy("part").collect()
    share = -(-total // parts)
    return Blocks([-1 if r["first"] is None else r["first"] for r in got], [max(1, r["flop"] // share) for r in got], max(r["rows"] for r in got), longest)


def lists(entries: DataFrame, keys: list[str], cut: bool, columns: list[str]) -> DataFrame:
    """The columns of entries as arrays, a row for each of keys; of long ones several rows."""
    if cut:
        size = entries.groupBy("k").agg(F.ceil(F.count("*") / CHUNK).alias("_cuts"))
        entries = entries.join(size, "k").withColumn("_cut", F.pmod(F.xxhash64(columns[0]), F.col("_cuts")))
        keys = [*keys, "_cut"]
    held = entries.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("_e"))
    # an array of each column is half as large as one of rows
    return held.select(*(k for k in keys if k != "_cut"), *(F.col(f"_e.{c}").alias(c) for c in columns))


def met(left: DataFrame, right: DataFrame, blocks: Blocks, hint: str | None = None) -> DataFrame:
    """(cell, i, j, x, y): the products of left(i, k, x) and right(j, k, y), partitioned by
    cell, with all products of a place in one of them.

    A cell is a block of rows. An inner id's entries in the block go there with those of
    the other side in one row, so an entry of the left side is sent once and one of the right
    side once for each block that has its inner id; products are made where they are added up.
    """
    own, other = [c for c in left.columns if c != "k"], [c for c in right.columns if c != "k"]
    block = range_of("i", blocks.firsts)
    rows = lists(left.withColumn("b", block), ["k", "b"], blocks.widest > CHUNK, own)
    cols = lists(right, ["k"], blocks.longest > CHUNK, other)
    both = rows.join(cols.hint(hint) if hint else cols, "k")
    at, n = 0, sum(blocks.pieces)
    if n == len(blocks.pieces):
        both = both.withColumn("cell", F.col("b").cast("int"))
        zipped = F.arrays_zip(*other)
    else:
        starts = []
        for p in blocks.pieces:
            starts.append(at)
            at += p
        number = lambda xs: F.expr(f"cast(split('{','.join(map(str, xs))}', ',') as array<int>)")
        both = both.withColumn("_n", F.get(number(blocks.pieces), F.col("b"))).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        both = both.withColumn("cell", (F.get(number(starts), F.col("b")) + F.col("_piece")).cast("int"))
        zipped = F.filter(F.arrays_zip(*other), lambda e: F.pmod(F.xxhash64(e["j"]), F.col("_n")) == F.col("_piece"))
        both = both.withColumn("_e", zipped).where(F.size("_e") > 0).withColumns({c: F.col(f"_e.{c}") for c in other})
        zipped = F.arrays_zip(*other)
    dealt = both.select("cell", *own, *other).repartitionById(n, F.col("cell"))
    half = dealt.select("cell", zipped.alias("_e"), F.inline(F.arrays_zip(*own)).alias(*own))
    return half.select("cell", *own, F.inline("_e").alias(*other))


def products(a: SparseMatrix, b: SparseMatrix, values: bool = True, hint: str | None = None) -> DataFrame:
    """met() of the entries of two matrices."""
    left, right = sides(a, b, values)
    return met(left, right, row_blocks(left, right), hint)


def added(both: DataFrame, mul: Callable, add: Callable) -> DataFrame:
    """(i, j, v) of products, added up in their cells."""
    return both.groupBy("cell", "i", "j").agg(add(mul(F.col("x"), F.col("y"))).cast("double").alias("v")).drop("cell")


def mirrored(df: DataFrame) -> DataFrame:
    """Entries of i <= j, and those off the diagonal turned round."""
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return df.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(both)).alias("p"), "v").select("p.*", "v")


def spgemm(a: SparseMatrix, b: SparseMatrix, mul: Callable = times, add: Callable = F.sum, hint: str | None = None, most: int | None = None) -> SparseMatrix:
    """a * b over a semiring: mul joins two value columns, add aggregates.

    Places whose values cancel stay, with value 0. hint is a join strategy of
    Spark (broadcast, shuffle_hash, merge); most refuses products beyond that
    many multiplications.
    """
    if most is not None:
        guard_flop(a, b, most)
    return SparseMatrix(added(products(a, b, hint=hint), mul, add), a.rows, b.cols)


def _alike(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, k, v) and (id, c) of entries(id, k, v): those of each class of ids that have the
    same ones, and the members. Entries without k meet no other."""
    lists = materialize(entries.where("k is not null").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("e")))
    classes = materialize(lists.groupBy("e").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("c"), "e"))
    members = materialize(lists.join(shipped(classes), lists["e"].eqNullSafe(classes["e"])).select("id", "c"))
    return classes.select("c", F.inline("e")), members


def shipped(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def salted_spgemm(a: SparseMatrix, b: SparseMatrix, salts: int = 16, hot: float = 1e-3, mul: Callable = times, add: Callable = F.sum) -> SparseMatrix:
    """a * b for skewed inner ids: entries of a at ids that hold more than the
    share hot of them are dealt over salts, and b's rows of these ids copied.

    Where inner ids are hot, many rows are alike. Rows of a with the same entries are
    multiplied once, and columns of b, too, if that leaves at most half of them; a
    place of that product stands for all its rows and columns, which are cut into
    tiles of WIDTH columns and about TASK places and need no shuffle of the products.
    """
    left, rows = _alike(a.df.select(F.col("i").alias("id"), F.col("j").alias("k"), "v"))
    right, cols = _alike(b.df.select(F.col("j").alias("id"), F.col("i").alias("k"), "v"))
    n, m = rows.count(), cols.count()
    if 2 * left.select("c").distinct().count() > n or 2 * right.select("c").distinct().count() > m:
        return SparseMatrix(_salted(a.df, b.df, salts, hot, mul, add), a.rows, b.cols)
    few = materialize(_salted(left.select(F.col("c").alias("i"), F.col("k").alias("j"), "v"), right.select(F.col("k").alias("i"), F.col("c").alias("j"), "v"), salts, hot, mul, add))
    (rows, own), (cols, other) = _cut(rows, TASK // WIDTH), _cut(cols, WIDTH)
    tiles = few.select(F.col("i").alias("ci"), F.col("j").alias("cj"), "v").join(own.toDF("ci", "pi"), "ci").join(other.toDF("cj", "pj"), "cj")
    tiles = materialize(tiles.select("pi", "pj", "v"))
    tasks = max(1, min(tiles.count(), max(salts, -(-n * m // TASK))))
    # a tile's rows one after the other, each with the same columns in the same order: files of this are small.
    # A stage of generated code holds all that comes of a row, so it ends at coalesce, and no tile is held
    dealt = tiles.repartition(tasks).join(shipped(rows.toDF("i", "pi")), "pi").coalesce(tasks)
    df = dealt.join(shipped(cols.toDF("j", "pj")), "pj").select("i", "j", "v")
    return SparseMatrix(df, a.rows, b.cols)


def _cut(members: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(id, p) of members(id, c), and (c, p): the pieces of their classes, of about size members each."""
    sizes = members.groupBy("c").agg(F.ceil(F.count("*") / size).alias("n"))
    pieces = materialize(sizes.select("c", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("t")).withColumn("p", F.monotonically_increasing_id()))
    dealt = members.join(shipped(pieces.where("t = 0").select("c", "n")), "c").withColumn("t", F.pmod(F.xxhash64("id"), F.col("n")))
    return materialize(dealt.join(shipped(pieces), ["c", "t"]).select("id", "p")), pieces.select("c", "p")


def _salted(a: DataFrame, b: DataFrame, salts: int, hot: float, mul: Callable, add: Callable) -> DataFrame:
    n = a.count()
    busy = a.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("_n")).where(F.col("_n") > hot * n).select("k", F.lit(True).alias("_hot"))
    busy = F.broadcast(busy)  # at most 1 / hot rows
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(busy, "k", "left")
    left = left.withColumn("s", F.when(F.col("_hot"), F.pmod(F.xxhash64("i"), F.lit(salts))).otherwise(0)).drop("_hot")
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")).join(busy, "k", "left")
    right = right.withColumn("s", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("_hot")
    return left.join(right, ["k", "s"]).groupBy("i", "j").agg(add(mul(F.col("x"), F.col("y"))).cast("double").alias("v"))


def gram(a: SparseMatrix, upper_only: bool = False, mul: Callable = times, add: Callable = F.sum) -> SparseMatrix:
    """a * transpose(a) for a mul that doesn't care for sides. Only i <= j is
    computed, and mirrored unless upper_only."""
    df = added(products(a, a.transpose()).where("i <= j"), mul, add)
    return SparseMatrix(df if upper_only else mirrored(df), a.rows, a.rows)


def join_project(a: SparseMatrix, b: SparseMatrix, hint: str | None = None) -> DataFrame:
    """Distinct (i, j) that the join of a and b reaches."""
    return products(a, b, False, hint).distinct().select("i", "j")


def join_aggregate(a: SparseMatrix, b: SparseMatrix, partitioned: bool = True) -> SparseMatrix:
    """a * b with a partitioned or a broadcast hash join. A right side of more than
    SMALL entries is not broadcast; the join is then partitioned, too."""
    partitioned = partitioned or b.df.limit(SMALL + 1).count() > SMALL
    return spgemm(a, b, hint="shuffle_hash" if partitioned else "broadcast")


def masked_product(a: SparseMatrix, b: SparseMatrix, mask: SparseMatrix, mul: Callable = times, add: Callable = F.sum) -> SparseMatrix:
    """Entries of a * b at places of mask. Each place takes its row of a, and that
    meets its column of b on both ids, so the work is that of the places' rows
    and not of the whole product."""
    wanted = mask.df.select("i", "j").distinct()
    left = wanted.join(a.df.select("i", F.col("j").alias("k"), F.col("v").alias("x")), "i")
    right = b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    df = left.join(right, ["k", "j"]).groupBy("i", "j").agg(add(mul(F.col("x"), F.col("y"))).cast("double").alias("v"))
    return SparseMatrix(df, a.rows, b.cols)


def spmv(a: SparseMatrix, x: DataFrame | float, dense: bool = False) -> DataFrame:
    """(i, v) of a * x for x(j, v) or a constant vector. dense adds rows that come out empty."""
    if isinstance(x, DataFrame):
        x = x.select("j", F.col("v").alias("x"))
        if x.limit(SMALL + 1).count() <= SMALL:
            x = F.broadcast(x)
        got = a.df.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    else:
        got = a.df.groupBy("i").agg(F.sum(F.col("v") * float(x)).alias("v"))
    if dense:
        every = a.df.sparkSession.range(a.n_rows).select(F.col("id").alias("i"))
        got = every.join(got, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))
    return got


def spmm(a: SparseMatrix, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """(i, k, v) of alpha * a * b + beta * c, with dense b(j, k, v) in long form."""
    got = a.df.join(b.select("j", "k", F.col("v").alias("y")), "j").groupBy("i", "k").agg((alpha * F.sum(F.col("v") * F.col("y"))).alias("v"))
    if c is not None and beta:
        got = got.unionByName(c.select("i", "k", (beta * F.col("v")).alias("v"))).groupBy("i", "k").agg(F.sum("v").alias("v"))
    return got

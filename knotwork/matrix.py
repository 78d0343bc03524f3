"""The matrix type: a coordinate DataFrame (i, j, v) with its shape.

An absent entry is zero. Entries may repeat; products are linear, so repeats
add up. Ids are 0-based longs and values doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COO = "i long, j long, v double"


class Extent:
    """A number of rows or columns that is found when it is first asked for."""

    def __init__(self, find: Callable[[], int]):
        self._find, self._value = find, None

    def __int__(self) -> int:
        if self._value is None:
            self._value = int(self._find())
        return self._value


def larger(*extents: int | Extent) -> int | Extent:
    if all(isinstance(x, int) for x in extents):
        return max(extents)
    return extents[0] if all(x is extents[0] for x in extents) else Extent(lambda: max(map(int, extents)))


@dataclass(frozen=True)
class SparseMatrix:
    df: DataFrame
    rows: int | Extent
    cols: int | Extent

    @property
    def n_rows(self) -> int:
        return int(self.rows)

    @property
    def n_cols(self) -> int:
        return int(self.cols)

    @staticmethod
    def of(df: DataFrame, i: str, j: str, v: str | None = None, n_rows: int | None = None, n_cols: int | None = None, bounds: DataFrame | None = None) -> SparseMatrix:
        """Entries from columns of any DataFrame; without a shape, one past the
        largest ids, found by one aggregation when a shape is first needed. bounds
        is a frame with the same largest ids that is cheaper to read, if there is one."""
        coo = df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), (F.col(v).cast("double") if v else F.lit(1.0)).alias("v"))
        frame, held = df if bounds is None else bounds, []

        def end(k: int) -> int:
            if not held:
                held.append(frame.agg(*(F.coalesce(F.max(F.col(c).cast("long")) + 1, F.lit(0)) for c in (i, j))).first())
            return held[0][k]

        return SparseMatrix(coo, Extent(lambda: end(0)) if n_rows is None else n_rows, Extent(lambda: end(1)) if n_cols is None else n_cols)

    @staticmethod
    def from_entries(spark: SparkSession, entries: list[tuple], n_rows: int, n_cols: int) -> SparseMatrix:
        rows = [(int(e[0]), int(e[1]), float(e[2]) if len(e) > 2 else 1.0) for e in entries]
        return SparseMatrix(spark.createDataFrame(rows, COO), n_rows, n_cols)

    def with_df(self, df: DataFrame) -> SparseMatrix:
        return replace(self, df=df)

    # conversions and filters: projections of the entries, without a shuffle
    def ones(self) -> SparseMatrix:
        return self.with_df(self.df.select("i", "j", F.lit(1.0).alias("v")))

    def transpose(self) -> SparseMatrix:
        return SparseMatrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.cols, self.rows)

    def drop_zeros(self) -> SparseMatrix:
        return self.with_df(self.df.where("v <> 0"))

    def drop_diagonal(self) -> SparseMatrix:
        return self.with_df(self.df.where("i <> j"))

    def tril(self) -> SparseMatrix:
        return self.with_df(self.df.where("i > j"))

    def triu(self) -> SparseMatrix:
        return self.with_df(self.df.where("i < j"))

    def rebase(self, by: int) -> SparseMatrix:
        """Ids moved by 1 or -1, to and from files that count from 1."""
        return self.with_df(self.df.select((F.col("i") + by).alias("i"), (F.col("j") + by).alias("j"), "v"))

    def merge_duplicates(self, add=F.sum) -> SparseMatrix:  # noqa: ANN001
        return self.with_df(self.df.groupBy("i", "j").agg(add("v").alias("v")))

    def pattern(self) -> SparseMatrix:
        """Distinct places, all with value 1."""
        return self.with_df(self.df.select("i", "j").distinct().withColumn("v", F.lit(1.0)))

    def symmetrize(self) -> SparseMatrix:
        """Pattern of the matrix and its transpose together, no diagonal."""
        both = self.df.select("i", "j").union(self.df.select("j", "i")).where("i <> j").distinct()
        n = larger(self.rows, self.cols)
        return SparseMatrix(both.withColumn("v", F.lit(1.0)), n, n)

    def to_csr(self) -> DataFrame:
        """(i, entries): the entries of each non-empty row by column."""
        return self.df.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("entries"))

    @staticmethod
    def from_csr(csr: DataFrame, n_rows: int, n_cols: int) -> SparseMatrix:
        return SparseMatrix(csr.select("i", F.inline("entries")), n_rows, n_cols)

    def to_csc(self) -> DataFrame:
        """(j, entries): the entries (i, v) of each non-empty column by row."""
        return self.df.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("entries"))

    @staticmethod
    def from_csc(csc: DataFrame, n_rows: int, n_cols: int) -> SparseMatrix:
        return SparseMatrix(csc.select("j", F.inline("entries")).select("i", "j", "v"), n_rows, n_cols)

    def shuffle_ids(self, seed: int = 0) -> DataFrame:
        """The row view with each row's entries in random order (by hash, so reruns agree)."""
        key = F.xxhash64("i", "j", F.lit(seed))
        rows = self.df.groupBy("i").agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), "j", "v"))).alias("e"))
        return rows.select("i", F.transform("e", lambda x: F.struct(x["j"].alias("j"), x["v"].alias("v"))).alias("entries"))

    def row_pointers(self) -> DataFrame:
        """(i, row_ptr) for all rows, empty ones included."""
        from .operators.layout import exclusive_scan

        return exclusive_scan(self.row_counts(), "i", "nnz", "row_ptr").select("i", "row_ptr")

    def row_counts(self) -> DataFrame:
        """(i, nnz) for all rows, 0 for empty ones."""
        every = self.df.sparkSession.range(self.n_rows).select(F.col("id").alias("i"))
        return every.join(self.df.groupBy("i").agg(F.count("*").alias("nnz")), "i", "left").select("i", F.coalesce("nnz", F.lit(0)).alias("nnz"))

    def split_rows(self, parts: int) -> DataFrame:
        """Entries with the block of rows they belong to: blocks of ceil(n / parts) rows."""
        per = -(-self.n_rows // parts) if self.n_rows else 1
        return self.df.withColumn("part", F.floor(F.col("i") / per))

    def ref(self, rows: DataFrame | None = None, cols: DataFrame | None = None, renumber: str = "both", repeats: bool = False) -> SparseMatrix:
        """Submatrix of rows(id) and cols(id). renumber: none, cols or both; ids
        are then ranks in ascending order. Repeated ids count once, or with
        repeats as often as they are given."""
        df, shape = self.df, [self.rows, self.cols]
        for axis, (name, ids) in enumerate((("i", rows), ("j", cols))):
            if ids is None:
                continue
            given = ids.select(F.col("id").alias(name))
            if renumber == "both" or (renumber == "cols" and name == "j"):
                own = dense_ids(ids, "id").select(F.col("id").alias(name), "rank")
                df = df.join(own if not repeats else own.join(given, name), name).withColumn(name, F.col("rank")).drop("rank").select("i", "j", "v")
                shape[axis] = Extent(own.count)
            elif repeats:
                df = df.join(given, name).select("i", "j", "v")
            else:
                df = df.join(given.distinct(), name, "left_semi").select("i", "j", "v")
        return SparseMatrix(df, *shape)

    def checksum(self) -> DataFrame:
        """One row: number of entries, sum of columns, sum of values."""
        return self.df.agg(F.count("*").alias("nnz"), F.coalesce(F.sum("j"), F.lit(0)).alias("sum_col"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum_val"))

    def out_of_range(self) -> DataFrame:
        """Entries outside the shape; none in a valid matrix."""
        return self.df.where((F.col("i") < 0) | (F.col("i") >= self.n_rows) | (F.col("j") < 0) | (F.col("j") >= self.n_cols))

    @staticmethod
    def unsorted(csr: DataFrame) -> DataFrame:
        """Rows of a row view whose entries, as they stand, aren't in ascending order."""
        return csr.where(F.col("entries") != F.array_sort("entries"))


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """(column, rank) for the distinct values: 0-based places in ascending
    order, by a two-level scan over sorted partitions."""
    from .operators.layout import global_rank

    return global_rank(df.select(column).where(F.col(column).isNotNull()).distinct(), [F.col(column)], "rank")


def intersect(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The values that both frames have, each once, in ascending order."""
    return a.select(column).distinct().join(b.select(column), column, "left_semi").orderBy(column)


def keep_mask(df: DataFrame, column: str, keep: DataFrame) -> DataFrame:
    """df with kept: whether the column's value is among those of keep(column)."""
    mark = keep.select(column).distinct().withColumn("kept", F.lit(True))
    return df.join(mark, column, "left").fillna(False, ["kept"])


def same(a: DataFrame, b: DataFrame, eps: float = 1e-3) -> DataFrame:
    """Places in which two coordinate DataFrames differ by more than eps,
    absolutely and relatively."""
    x = a.groupBy("i", "j").agg(F.sum("v").alias("x"))
    y = b.groupBy("i", "j").agg(F.sum("v").alias("y"))
    both = x.join(y, ["i", "j"], "full").fillna(0.0, ["x", "y"])
    gap = F.abs(F.col("x") - F.col("y"))
    return both.where((gap > eps) & (gap > eps * F.greatest(F.abs("x"), F.abs("y"))))

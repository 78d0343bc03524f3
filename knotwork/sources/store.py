"""Matrices kept as bucketed tables, so that repeated products need no exchange for
their joins.

A stored matrix is two tables of the same entries, one bucketed and sorted by row
and one by column, with its shape among their properties. a * b joins a's table
by column with b's by row: with equal numbers of buckets both lie as the join
wants them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..operators.product import added, met, row_blocks, times


@dataclass(frozen=True)
class StoredMatrix:
    by_row: DataFrame
    by_col: DataFrame
    n_rows: int
    n_cols: int

    @property
    def matrix(self) -> SparseMatrix:
        return SparseMatrix(self.by_row, self.n_rows, self.n_cols)

    def transpose(self) -> StoredMatrix:
        flip = lambda df: df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        return StoredMatrix(flip(self.by_col), flip(self.by_row), self.n_cols, self.n_rows)


def save(m: SparseMatrix, name: str, path: str | None = None, buckets: int = 200) -> None:
    """Tables name_by_row and name_by_col, in the warehouse or under a path that all
    machines share; tables of these names are replaced."""
    spark = m.df.sparkSession
    for side, column in (("by_row", "i"), ("by_col", "j")):
        rows = m.df.select("i", "j", "v").repartition(buckets, column)  # a file for each bucket
        writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, column).sortBy(column)
        (writer.option("path", f"{path}/{side}") if path else writer).saveAsTable(f"{name}_{side}")
        spark.sql(f"ALTER TABLE {name}_{side} SET TBLPROPERTIES ('n_rows' = '{m.n_rows}', 'n_cols' = '{m.n_cols}')")


def load(spark: SparkSession, name: str) -> StoredMatrix:
    shape = {r["key"]: int(r["value"]) for r in spark.sql(f"SHOW TBLPROPERTIES {name}_by_row").collect() if r["key"] in ("n_rows", "n_cols")}
    return StoredMatrix(spark.table(f"{name}_by_row"), spark.table(f"{name}_by_col"), shape["n_rows"], shape["n_cols"])


def remove(spark: SparkSession, name: str) -> None:
    """Forget the tables; files under a path of one's own stay."""
    for side in ("by_row", "by_col"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{side}")


def stored_spgemm(a: StoredMatrix, b: StoredMatrix, mul: Callable = times, add: Callable = F.sum) -> SparseMatrix:
    """a * b; the join reads both sides bucket by bucket."""
    if a.n_cols != b.n_rows:
        raise ValueError(f"shapes {a.n_rows}x{a.n_cols} and {b.n_rows}x{b.n_cols} don't fit")
    left = a.by_col.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.by_row.select("j", F.col("i").alias("k"), F.col("v").alias("y"))
    return SparseMatrix(added(met(left, right, row_blocks(left, right), "merge"), mul, add), a.n_rows, b.n_cols)

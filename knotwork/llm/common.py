"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, shared_folder

__all__ = ["MAX_SHIPPED_BYTES", "bounded", "check_shipped", "components", "held_out", "materialize", "quoted", "remove_folder", "shared_folder", "table", "texts_of", "unused"]

#: Largest object, in bytes, that an operator of this package ships to every executor.
MAX_SHIPPED_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has, whatever its case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def check_shipped(n_bytes: int, what: str) -> None:
    if n_bytes > MAX_SHIPPED_BYTES:
        raise ValueError(f"{what} takes {n_bytes} bytes; at most {MAX_SHIPPED_BYTES} are sent to every executor")


def texts_of(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def bounded(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about max_bytes, one row at least, so that
    working memory follows the slice and not the Arrow batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * max_bytes / max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b): label is the smallest node
    that can be reached. Alternating large and small stars; every round is
    checkpointed, and only one count per round reaches the driver.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialize(small.where("a <> b").distinct())
        # star forest: a fixed point has the same number of edges and the same sum of ends
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = after

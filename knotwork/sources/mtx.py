"""Matrix Market text and binary coordinate files.

Readers of local files plan byte (or record) ranges on the driver from the file's
size and leave the parsing to the executors; paths must be readable by all
machines. Matrix Market goes to any other file system, too, by Spark's own text
splits: a path with a scheme is a file, or a folder of a header and parts.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..matrix import COO, SparseMatrix
from ..storage import materialize

#: Fixed value: one record is row, column and value; the first one holds the shape.
RECORD = np.dtype([("i", "<i8"), ("j", "<i8"), ("v", "<f8")])
RANGE_BYTES = 64 << 20


@dataclass
class Header:
    n_rows: int
    n_cols: int
    nnz: int
    symmetric: bool
    general: bool
    data: int  # where the first data line starts


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        symmetric, general, first = False, False, True
        while line := f.readline():
            if line.startswith(b"%"):
                if first and line.startswith(b"%%MatrixMarket"):
                    words = line.lower().split()
                    if {b"skew-symmetric", b"hermitian"} & set(words):
                        raise ValueError("only general and symmetric matrices can be read")
                    symmetric, general = b"symmetric" in words, b"general" in words
                first = False
                continue
            if line.strip():
                a, b, n = (int(x) for x in line.split()[:3])
                return Header(a, b, n, symmetric, general, f.tell())
    raise ValueError(f"{path} has no size line")


@dataclass
class Range(InputPartition):
    start: int
    end: int


def _ranges(start: int, end: int, step: int) -> list[Range]:
    return [Range(k, min(end, k + step)) for k in range(start, end, step)] or [Range(start, start)]


def _batch(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v, pa.float64())], ["i", "j", "v"])


class MtxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return _ranges(read_header(self.path).data, os.path.getsize(self.path), self.step)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Lines that start in the range; a line over its end belongs to it."""
        with open(self.path, "rb") as f:
            at = partition.start
            if at > read_header(self.path).data:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            rows: list[tuple[int, int, float]] = []
            while at < partition.end and (line := f.readline()):
                at += len(line)
                w = line.split()
                if len(w) >= 2 and not line.startswith(b"%"):
                    rows.append((int(w[0]) - 1, int(w[1]) - 1, float(w[2]) if len(w) > 2 else 1.0))
                if len(rows) == 100_000:
                    yield _batch(*map(np.array, zip(*rows, strict=True)))
                    rows = []
            if rows:
                yield _batch(*map(np.array, zip(*rows, strict=True)))


class MtxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return COO

    def reader(self, schema) -> MtxReader:  # noqa: ANN001
        return MtxReader(dict(self.options))


class BinReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = max(1, int(options.get("rangebytes", RANGE_BYTES)) // RECORD.itemsize)

    def partitions(self) -> list[Range]:
        return _ranges(1, os.path.getsize(self.path) // RECORD.itemsize, self.step)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for at in range(partition.start, partition.end, 1 << 18):
            r = np.fromfile(self.path, RECORD, min(1 << 18, partition.end - at), offset=at * RECORD.itemsize)
            yield _batch(r["i"], r["j"], r["v"])


class BinSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "coobin"

    def schema(self) -> str:
        return COO

    def reader(self, schema) -> BinReader:  # noqa: ANN001
        return BinReader(dict(self.options))


def _elsewhere(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _banner(lines: list[str]) -> tuple[Header, str] | None:
    """The header and its size line, if they are among a file's first lines."""
    words = lines[0].lower().split() if lines and lines[0].startswith("%%MatrixMarket") else []
    if {"skew-symmetric", "hermitian"} & set(words):
        raise ValueError("only general and symmetric matrices can be read")
    for line in lines:
        if line.strip() and not line.startswith("%"):
            a, b, n = (int(x) for x in line.split()[:3])
            return Header(a, b, n, "symmetric" in words, "general" in words, 0), line
    return None


def _read_lines(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """Header and entries of a file or folder anywhere, split as Spark splits text."""
    if _exists(spark, f"{path}/header"):
        head = _banner([r["value"] for r in spark.read.text(f"{path}/header").coalesce(1).collect()])
        lines = spark.read.text(f"{path}/entries")
    else:
        lines, n, head = spark.read.text(path), 64, None
        while head is None:
            first = [r["value"] for r in lines.head(n)]
            head = _banner(first)
            if head is None and len(first) < n:
                raise ValueError(f"{path} has no size line")
            n *= 8
        # the size line goes once; entries that read the same stay
        again = lines.where(F.col("value") == head[1]).groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
        again = again.select("value", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select("value")
        lines = lines.where(F.col("value") != head[1]).unionByName(again)
    w = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.startswith("value", F.lit("%"))).select(w.alias("w")).where(F.size("w") >= 2)
    value = F.when(F.size("w") > 2, F.get("w", F.lit(2)).cast("double")).otherwise(1.0)
    return head[0], rows.select((F.col("w")[0].cast("long") - 1).alias("i"), (F.col("w")[1].cast("long") - 1).alias("j"), value.alias("v"))


def read_mtx(spark: SparkSession, path: str, values: str = "keep", range_bytes: int = RANGE_BYTES, unless_general: bool = False) -> SparseMatrix:
    """values: keep, or ones for a pattern. Zeros are dropped, repeats kept, a
    symmetric file's entries off the diagonal mirrored. unless_general mirrors
    all files whose banner doesn't say general, those without one included."""
    if _elsewhere(path):
        h, df = _read_lines(spark, path)
    else:
        spark.dataSource.register(MtxSource)
        h, df = read_header(path), spark.read.format("mtx").option("path", path).option("rangeBytes", str(range_bytes)).load()
    df, mirror = df.where("v <> 0"), unless_general and not h.general
    if h.symmetric or mirror:
        df = df.unionByName(df.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    m = SparseMatrix(df, h.n_rows, h.n_cols)
    return m.ones() if values == "ones" else m


def read_bin(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> SparseMatrix:
    spark.dataSource.register(BinSource)
    head = np.fromfile(path, RECORD, 1)[0]
    df = spark.read.format("coobin").option("path", path).option("rangeBytes", str(range_bytes)).load()
    return SparseMatrix(df, int(head["i"]), int(head["j"]))


class ColumnsReader(DataSourceReader):
    """Ranges of entries of a file that holds its rows, columns and values one after the other."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = max(1, int(options.get("rangebytes", RANGE_BYTES)) // RECORD.itemsize)
        self.nnz = int(np.fromfile(self.path, "<i8", 3)[2])

    def partitions(self) -> list[Range]:
        return _ranges(0, self.nnz, self.step)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for at in range(partition.start, partition.end, 1 << 18):
            n = min(1 << 18, partition.end - at)
            yield _batch(*(np.fromfile(self.path, kind, n, offset=24 + 8 * (k * self.nnz + at)) for k, kind in enumerate(("<i8", "<i8", "<f8"))))


class ColumnsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "coocolumns"

    def schema(self) -> str:
        return COO

    def reader(self, schema) -> ColumnsReader:  # noqa: ANN001
        return ColumnsReader(dict(self.options))


def read_columns(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> SparseMatrix:
    """The layout of a header m, n, nnz followed by whole arrays of rows, columns and values."""
    spark.dataSource.register(ColumnsSource)
    m, n, _ = (int(x) for x in np.fromfile(path, "<i8", 3))
    return SparseMatrix(spark.read.format("coocolumns").option("path", path).option("rangeBytes", str(range_bytes)).load(), m, n)


def read_matrix(spark: SparkSession, path: str, **options) -> SparseMatrix:
    """By suffix: .bin or .mtx."""
    return read_bin(spark, path) if path.endswith(".bin") else read_mtx(spark, path, **options)


def load_pair(spark: SparkSession, name: str, folder: str = ".") -> tuple[SparseMatrix, SparseMatrix]:
    """Operands of a dataset: name.org and name.trs, or name.org and its transpose."""
    a = read_mtx(spark, os.path.join(folder, f"{name}.org"))
    other = os.path.join(folder, f"{name}.trs")
    there = _exists(spark, other) if _elsewhere(other) else os.path.exists(other)
    return a, (read_mtx(spark, other) if there else a.transpose())


def _write_ranges(rows: DataFrame, size: Column, render: Callable[[pa.RecordBatch], bytes], path: str, head: bytes) -> None:
    """One file: head, then what render makes of rows in the order of i and j.

    Rows are dealt by ranges and written once, so the bytes of each range are
    known before any goes to the file, and every task writes at its own place; a
    task done again writes the same bytes. Only a number for each range reaches
    the driver.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = materialize(rows.repartitionByRange(n, "i", "j").sortWithinPartitions("i", "j").withColumn("_part", F.spark_partition_id()))
    at, offsets = len(head), {}
    for part, own in sorted(map(tuple, held.groupBy("_part").agg(F.sum(size)).collect())):
        offsets[part], at = at, at + own
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, done = None, 0
        with open(path, "r+b") as f:
            for b in batches:
                if b.num_rows:
                    place = offsets[b.column("_part")[0].as_py()] if place is None else place
                    f.seek(place)
                    place += f.write(render(b))
                    done += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["n"])

    held.mapInArrow(run, "n long").agg(F.sum("n")).first()


def write_mtx(m: SparseMatrix, path: str, values: str = "keep", symmetric: bool = False, dedup: bool = False) -> None:
    """One file, ordered, 1-based, written by all tasks at their places. values:
    keep, ones or none (pattern); symmetric writes i <= j only; dedup keeps the
    smallest value of each place. On a path with a scheme, a folder of a header
    and of parts in order."""
    df = m.df.where("i <= j") if symmetric else m.df
    df = df.groupBy("i", "j").agg(F.min("v").alias("v")) if dedup else df
    tail = {"keep": [F.col("v").cast("string")], "ones": [F.lit("1.000000")], "none": []}[values]
    lines = df.select("i", "j", F.concat(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, *tail), F.lit("\n")).alias("value"))
    kind, shape = "pattern" if values == "none" else "real", "symmetric" if symmetric else "general"
    head = f"%%MatrixMarket matrix coordinate {kind} {shape}\n{m.n_rows} {m.n_cols} {df.count()}\n"
    if _elsewhere(path):
        lines = lines.orderBy("i", "j").select(F.rtrim(F.col("value"), F.lit("\n")).alias("value"))
        lines.write.mode("overwrite").text(f"{path}/entries")
        df.sparkSession.range(1).select(F.lit(head.rstrip("\n")).alias("value")).write.mode("overwrite").text(f"{path}/header")
        return
    _write_ranges(lines, F.octet_length("value"), lambda b: "".join(b.column("value").to_pylist()).encode(), path, head.encode())


def write_bin(m: SparseMatrix, path: str) -> None:
    """The record of the shape, then a record for each entry, in order."""

    def render(b: pa.RecordBatch) -> bytes:
        out = np.empty(b.num_rows, RECORD)
        for k in "ijv":
            out[k] = b.column(k).to_numpy()
        return out.tobytes()

    _write_ranges(m.df.select("i", "j", "v"), F.lit(RECORD.itemsize), render, path, np.array([(m.n_rows, m.n_cols, m.df.count())], RECORD).tobytes())


def transpose_file(spark: SparkSession, source: str, org: str, trs: str) -> None:
    """A matrix or edge file as the pair of a pattern and its transpose."""
    from .files import read_edges

    m = (read_mtx(spark, source) if source.endswith(".mtx") else read_edges(spark, source)).ones()
    write_mtx(m, org, "ones")
    write_mtx(m.transpose(), trs, "ones")

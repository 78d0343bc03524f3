"""Text and delimited sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix


def read_edges(spark: SparkSession, path: str, both: bool = True, n: int | None = None) -> SparseMatrix:
    """Tab-separated 0-based edges. n defaults to 2^scale from a file name
    kind_scale_factor; both adds each edge's reverse. Self loops are refused."""
    e = spark.read.csv(path, sep="\t", schema="i long, j long").where("i is not null and j is not null")
    loop = F.assert_true(F.col("i") != F.col("j"), F.lit("an edge joins a vertex to itself"))
    e = e.where(loop.isNull())
    if n is None:
        m = re.search(r"_(\d+)_\d+(?:\.\w+)?$", path)
        n = 1 << int(m[1]) if m else e.agg(F.coalesce(F.greatest(F.max("i"), F.max("j")) + 1, F.lit(0))).first()[0]
    if both:
        e = e.union(e.select("j", "i"))
    return SparseMatrix(e.withColumn("v", F.lit(1.0)), n, n)


def write_edges(m: SparseMatrix, path: str) -> None:
    m.df.select("i", "j").write.csv(path, sep="\t")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="a long, b long").where("a is not null and b is not null")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="id long, name string", quote="")


def write_names(names: DataFrame, path: str) -> None:
    """new_id (from 1) and name, tab-separated."""
    names.select("id", F.translate("name", "\t\n\r", "   ")).orderBy("id").write.csv(path, sep="\t", quote="")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where("trim(value) <> ''").count()


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with _line, which orders them by file and place; blank and bad lines are skipped."""
    df = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return df.withColumn("_line", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def split_json(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Fields of JSON lines as strings, found by a pattern without a schema: quoted
    values, numbers and literals; null where a line lacks the field."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    one = lambda f: F.coalesce(*(F.nullif(F.regexp_extract("value", rf'"{re.escape(f)}"\s*:\s*{p}', 1), F.lit("")) for p in (r'"((?:[^"\\]|\\.)*)"', r"([^\s,\"\[{}\]]+)")))
    return lines.select(*(one(f).alias(f) for f in fields))


def read_title_types(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(title) of the wanted types, from a gzipped table with header."""
    t = spark.read.csv(path, sep="\t", header=True, quote="")
    return t.where(F.col("titleType").isin(wanted)).select(F.substring("tconst", 3, 20).cast("long").alias("title"))


def read_principals(spark: SparkSession, path: str, categories: list[str] | None = None, titles: DataFrame | None = None) -> DataFrame:
    """(title, person) from a gzipped table with header, of the given categories and
    titles(title); ids lose their two-letter prefix."""
    t = spark.read.csv(path, sep="\t", header=True, quote="")
    t = t.where(F.col("category").isin(categories)) if categories else t
    t = t.select(F.substring("tconst", 3, 20).cast("long").alias("title"), F.substring("nconst", 3, 20).cast("long").alias("person"))
    return t if titles is None else t.join(titles.select("title"), "title", "left_semi")


def read_ratings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(user, item, rating): the first three columns of a delimited file with header."""
    t = spark.read.csv(path, sep=sep, header=True)
    return t.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(t.columns, ("user", "item", "rating"), strict=False)))


def write_sorted_csv(m: SparseMatrix, path: str) -> None:
    """Header users,items,nnz and 1-based rows, ordered."""
    head = m.df.sparkSession.createDataFrame([(m.n_rows, m.n_cols)], "a long, b long").crossJoin(m.df.agg(F.count("*").alias("n")))
    head = head.select(F.concat_ws(",", "a", "b", "n").alias("value"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"))
    rows = m.df.select(F.concat_ws(",", F.col("i") + 1, F.col("j") + 1, "v").alias("value"), "i", "j")
    head.unionByName(rows).orderBy("i", "j").select("value").write.text(path)


def write_dimacs(m: SparseMatrix, path: str) -> None:
    """p sp n m, then a u v w lines, 1-based, in order."""
    head = m.df.agg(F.format_string("p sp %d %d", F.lit(m.n_rows), F.count("*")).alias("value")).select("value", F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"))
    arcs = m.df.select(F.format_string("a %d %d %d", F.col("i") + 1, F.col("j") + 1, F.col("v").cast("long")).alias("value"), "i", "j")
    # by the ends of arcs, so that they are dealt over tasks
    head.unionByName(arcs).orderBy("i", "j").select("value").write.text(path)


def read_dimacs(spark: SparkSession, path: str) -> SparseMatrix:
    """The arcs of a p sp file, 0-based; comments are skipped, n is that of the p line."""
    lines = spark.read.csv(path, sep=" ", schema="kind string, i string, j long, v long")
    sizes = [r["j"] for r in lines.where("kind = 'p'").select("j").take(2)]
    if len(sizes) != 1:
        raise ValueError(f"{len(sizes) or 'no'} p lines in {path}")
    arcs = lines.where("kind = 'a'").select((F.col("i").cast("long") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.col("v").cast("double").alias("v"))
    return SparseMatrix(arcs, sizes[0], sizes[0])

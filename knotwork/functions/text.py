"""Text functions of the preparation steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..operators.layout import global_rank, remap_dense
from ..storage import materialize

#: English words left out of vocabularies.
STOP_WORDS = (
    "a an the of in on at to for with by from as and or but is are was were be been being this that these those it its we "
    "our you your they their he she his her not no so than then if into via using based towards toward"
).split()


def tokenize(text: Column, stop_words: list[str] | None = None) -> Column:
    """Distinct lower-case words of two letters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    words = F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS if stop_words is None else stop_words)))


def sanitize(text: Column) -> Column:
    return F.trim(F.translate(text, "\t\n\r", "   "))


def document_frequency(docs: DataFrame, text: str, least: int = 2) -> DataFrame:
    """(term, df) of terms in at least so many documents."""
    terms = docs.select(F.explode(tokenize(F.col(text))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def vocabulary(docs: DataFrame, text: str, least: int = 2) -> DataFrame:
    """(term, term_id): 1-based ids in the order of terms."""
    terms = document_frequency(docs, text, least).select("term")
    return global_rank(terms, [F.col("term")], "r").select("term", (F.col("r") + 1).alias("term_id"))


def document_terms(docs: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """(key, term_id) edges over the vocabulary. Tokens are made once: their counts
    and ids come from the same written rows."""
    words = materialize(docs.select(key, F.explode(tokenize(F.col(text))).alias("term")))
    kept = words.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least).select("term")
    ids = global_rank(kept, [F.col("term")], "r").select("term", (F.col("r") + 1).alias("term_id"))
    return words.join(ids, "term").select(key, "term_id")


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, value) of "key: value" lines, terminal colours removed."""
    clean = F.regexp_replace(F.col(column), r"\x1b\[[0-9;]*[A-Za-z]", "")
    return lines.select(F.trim(F.regexp_extract(clean, r"^([^:]+):\s*(.*)$", 1)).alias("key"), F.trim(F.regexp_extract(clean, r"^([^:]+):\s*(.*)$", 2)).alias("value")).where("key <> ''")


def sample_uniform(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Rows of n keys drawn by a hash, alike in every run."""
    keys = df.select(key).distinct().orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
    return df.join(keys, key, "left_semi")


def sample_top(df: DataFrame, key: str, n: int, line: str | None = None) -> DataFrame:
    """Rows of the n keys with the most rows, ties to the smaller key, or to the one
    that appears first by line."""
    tie = F.min(line) if line else F.first(F.col(key))
    keys = df.groupBy(key).agg(F.count("*").alias("_n"), tie.alias("_tie")).orderBy(F.desc("_n"), "_tie", key).limit(n).select(key)
    return df.join(keys, key, "left_semi")


def dense_sample(df: DataFrame, user: str, item: str) -> SparseMatrix:
    """A sample as a matrix: users and items renumbered in ascending order."""
    dense = remap_dense(df.select(user, item).distinct(), user, item)
    return SparseMatrix.of(dense, user, item)

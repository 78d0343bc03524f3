"""A corpus from documents to packed token ids in five stages.

Each stage takes what its predecessor kept as Parquet, and all but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import decontam, langid, mixing, packing, simhash
from knotwork.llm.common import remove_folder, shared_folder, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that no learned language explains.

    Null, empty and letterless texts go. Repeated rows, rows without doc_id,
    extra columns of any name: see langid.stage. Long texts are read whole, in
    pieces; languages equally likely go by name. An empty table stays empty, here
    and in all stages.
    """
    return langid.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest doc_id.

    Five-word shingles and a similarity of 0.8. Rows with equal doc_id and
    different texts are different documents; of rows equal in both one stays;
    rows without doc_id stay only in groups of their own. Null and empty texts
    are one group.
    """
    return simhash.stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a passage of the benchmark.

    Null and empty texts hold none; long texts are read whole, in pieces. There are
    no ties: any item found is enough, and rows alike in everything are judged
    alike. Extra columns of any name stay as they are.
    """
    return decontam.stage(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks. A null source is
    one of its own; texts without words are taken as the whole part of the
    source's factor says."""
    return mixing.stage(docs)


def token_packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids packed into rows; a null or empty text is its end id alone.

    Long texts are split into segments without loss. Of packs with equal room the
    first takes a segment, segments equally long go by their order in the
    partition; repeated rows get a place each. Of docs only doc_id and text are
    looked at, whatever other columns are named.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_packs", token_packs),
]

#: Learned, drawn and hashed as SQL cannot; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written and read again. Once a
    stage's result is written, that of the one before goes; the input of the last
    stage stays, since the returned rows are read from it."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)

"""The folder that all machines share, and results written there."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where that is unset, a session in one JVM (tests) gets a temporary folder; a
    cluster must name one, since a local folder isn't seen by other machines.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not named:
            folder = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(named or folder)
    return named or sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor
    changes nothing in it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""Incremental A * transpose(A) over an event stream (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, user_id, event_type, n) by tumbling windows of events(ts, user_id,
    event_type), streaming or not. A window's state ends with the watermark."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "user_id", "event_type", "n")
    )


def add_batch(target: str):  # noqa: ANN201
    """For foreachBatch: appends each batch's pairs of users that share a type in a
    window, so that their sum over batches is the product by window."""

    def run(batch: DataFrame, batch_id: int) -> None:
        a = batch.select("start", "event_type", F.col("user_id").alias("i"), F.col("n").alias("x"))
        b = batch.select("start", "event_type", F.col("user_id").alias("j"), F.col("n").alias("y"))
        pairs = a.join(b, ["start", "event_type"]).where("i <= j").groupBy("start", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
        pairs.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")  # a batch done again replaces itself

    return run

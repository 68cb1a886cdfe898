"""Counts that follow streams of links or flips, kept exactly by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def link_counts(stream: DataFrame, at: str, delay: str, window: str, by: str) -> DataFrame:
    """(start, key, n): new links per window of event time and value of ``by``; rows later than ``delay`` are dropped by the watermark."""
    kept = stream.withWatermark(at, delay)
    return kept.groupBy(F.window(at, window).alias("w"), F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "key", "n")


def ones_by_clique(flips: DataFrame, clique: str) -> DataFrame:
    """(clique, n_ones): running sum of flips (old, new), to be written in update or complete mode."""
    d = F.col("new").cast("long") - F.col("old").cast("long")
    return flips.groupBy(F.col(clique).alias("clique")).agg(F.sum(d).alias("n_ones"))


def each_batch(stream: DataFrame, path: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Applies a batch operator to every micro-batch and writes its result under the batch's number.

    A batch that is run again after a failure overwrites its own folder, so results stay exact.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

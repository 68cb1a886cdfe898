"""Top N items within every group, by score histograms and exact ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladewise.store import Cuts

#: Groups of more items get a threshold from their histogram.
LARGE = 500
#: Bins of one octave of scores.
FINE = 256
#: Slices that a group with a threshold is joined and ranked in, so that it never meets in one task, be all its scores equal. The
#: thresholds stand once per slice: SLICES / LARGE of the items at most.
SLICES = 64


def _bin(score: F.Column) -> F.Column:
    """A bin that never falls while the score rises: octaves in FINE parts, by the logarithm."""
    return F.floor(F.log2(score) * FINE).cast("int")


def thresholds(best: DataFrame, n: int, large: int = LARGE) -> DataFrame:
    """For each group of more than ``large`` items the highest bin above whose lower edge it has at least ``n`` of them: (g, least).

    ``best`` (g, item, score) holds an item once per group, so repeated rows can't make the threshold unsafe. Histograms of all
    groups are counted in the map tasks; the window runs over a group's bins, not over its rows. No threshold drops anything
    where a group has fewer than ``n`` items.
    """
    bins = best.groupBy("g", _bin(F.col("score")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("g").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    enough = F.max(F.when(F.col("above") >= n, F.col("bin")))
    return bins.withColumn("above", above).groupBy("g").agg(F.sum("n").alias("size"), enough.alias("least")).where(F.col("size") > max(large, n)).select("g", "least")


def top_items(df: DataFrame, group: str, item: str, score: str, n: int = 5, large: int = LARGE) -> DataFrame:
    """The ``n`` best items of each group: (group, item, score, rank) under the given column names.

    Rows with a null group, item or score, and scores that are NaN, infinite or not above 0, don't count. An item stands
    once per group, with its highest score. Order: falling score, then rising item by bytes. Groups with fewer items give
    all of them; an empty table gives no rows. Other columns don't matter, whatever their names.

    The best score of each (group, item) is written to the shared folder, spread by both. From it come the histograms of all
    groups, and from those the threshold of each large one, which at least ``n`` items reach. Rows below are dropped before
    anything is brought together by group. Survivors of a large group are ranked in slices first, so ties of any number never
    meet in one task.
    """
    g, i, s = (F.col(f"`{c}`") for c in (group, item, score))
    rows = df.select(g.cast("string").alias("g"), i.cast("string").alias("item"), s.cast("double").alias("score")).where(
        "g is not null and item is not null and score > 0 and not isnan(score) and score < double('infinity')"
    )
    cuts = Cuts(df.sparkSession, "top")
    best = cuts.save("best", rows.groupBy("g", "item").agg(F.max("score").alias("score")))
    least = cuts.save("least", thresholds(best, n, large))
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    hit = best.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(SLICES)).cast("int")).join(least.withColumn("slice", slices), ["g", "slice"], "left")
    left = hit.where(F.col("least").isNull() | (_bin(F.col("score")) >= F.col("least"))).withColumn("slice", F.when(F.col("least").isNotNull(), F.col("slice")).otherwise(0))
    order = [F.desc("score"), F.asc("item")]
    first = left.withColumn("r", F.row_number().over(Window.partitionBy("g", "slice").orderBy(*order))).where(F.col("r") <= n)
    rank = F.row_number().over(Window.partitionBy("g").orderBy(*order))
    return first.select("g", "item", "score").withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("g").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")

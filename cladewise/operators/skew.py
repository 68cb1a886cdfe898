"""Keys that hold many rows: finding them, and joins that don't send them to one task."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.store import Cuts

#: A key is hot from this share of the rows; so at most 1 / HOT_SHARE keys are, and their list may be broadcast.
HOT_SHARE = Decimal("0.001")
#: A key of fewer rows isn't hot, whatever its share: any task holds them.
HOT_ROWS = 2_000
#: Slices that a hot key's rows are spread over, at least; as many as a shuffle has partitions if those are more.
SLICES = 64


def slices_of(rows: DataFrame) -> int:
    return max(SLICES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def share_of(total: Column, share: Decimal | float) -> Column:
    """``share`` of ``total`` in decimal arithmetic, so that a bound is met exactly."""
    return total.cast("decimal(20,0)") * F.lit(Decimal(str(share)))


def hot_keys(rows: DataFrame, keys: list[str], share: Decimal = HOT_SHARE) -> DataFrame:
    """Key values that hold at least ``share`` of the rows of ``rows``, and HOT_ROWS: there are at most 1 / share of them.

    ``rows`` is read once: its counts are written to the shared folder, and their total and the few hot keys come from there.
    """
    cuts = Cuts(rows.sparkSession, "hot")
    counted = cuts.save("counts", rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    hot = cuts.save("keys", counted.where((F.col("_n") >= HOT_ROWS) & (F.col("_n") >= share_of(total, share))).select(*keys))
    cuts.drop("counts")
    return hot


def sliced(rows: DataFrame, hot: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """``rows`` with a column ``_slice``: 0, or for hot keys a number made from ``by``. ``hot`` comes from hot_keys."""
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    return marked.withColumn("_slice", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(slices_of(rows)))).otherwise(0).cast("int")).drop("_hot")


def copied(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_slice``, where rows of hot keys stand once per slice."""
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(slices_of(rows) - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("_slice", F.explode(every)).drop("_hot")


def lookup(rows: DataFrame, table: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table``, which holds each key once. Hot keys of ``rows`` are found first and spread over slices.

    Rows with a null key match nothing.
    """
    hot = hot_keys(rows.where(F.col(key).isNotNull()), [key])
    return sliced(rows, hot, [key], by).join(copied(table, hot, [key]), [key, "_slice"], how).drop("_slice")


def hot_from(size: int) -> float:
    """The number of rows from which a key of a table of ``size`` rows is hot."""
    return max(HOT_ROWS, size * float(HOT_SHARE))


def census(rows: DataFrame, key: str, least: float) -> tuple[int, list]:
    """The number of rows, and the keys that hold at least ``least`` of them, in one job. The keys reach the driver: with ``least`` a
    share of a table that ``rows`` is a part of there are at most 1 / share."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.collect_list(F.when(F.col("_n") >= least, F.col(key))).alias("hot")).first()
    return found.n, found.hot


def lookup_known(rows: DataFrame, table: DataFrame, key: str, by: Column, hot: list, how: str = "inner") -> DataFrame:
    """As lookup, where the hot keys are known already."""
    if not hot:
        return rows.join(table, key, how)
    is_hot, slices = F.col(key).isin(*hot), slices_of(rows)
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0)))
    own = F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(slices))).otherwise(0).cast("int")
    return rows.withColumn("_slice", own).join(table.withColumn("_slice", F.explode(every)), [key, "_slice"], how).drop("_slice")

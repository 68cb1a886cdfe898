"""Items that appear together: a blocked Gram matrix of baskets and items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.operators.skew import copied, hot_keys, share_of, sliced
from cladewise.store import Cuts

#: Items of a block, about; the product of two blocks is a dense table of counts in its task.
TILE = 512
#: Matrix entries of a block of records, about.
ENTRIES = 250_000
#: Pairs of a chunk of records that are multiplied sparsely at a time.
CHUNK = 2_000_000
#: Chunks whose product has one entry in so many of the dense one's are multiplied densely.
DENSE = 64
#: An item or basket with this share of the rows is spread over slices in the joins; 1,000 are at most.
HOT = 0.001
_GRAM = "a long, b long, n long"


def transposed_product(total: np.ndarray, left: np.ndarray, nl: np.ndarray, right: np.ndarray, nr: np.ndarray) -> None:
    """Adds L'R to ``total`` for one block of records: L and R are binary, given as rows of column codes with their lengths.

    Where the rows are full the blocks are made dense and multiplied; else only the ones meet. Both give the same counts.
    """
    ends = np.cumsum(nl.astype(np.int64) * nr)
    first_l, first_r = np.cumsum(nl) - nl, np.cumsum(nr) - nr
    at, width = 0, total.shape[1]
    while at < len(nl):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        n, m = nl[at:stop].astype(np.int64), nr[at:stop].astype(np.int64)
        whole = int(ends[stop - 1] - done)
        own, other = left[first_l[at] : first_l[at] + n.sum()], right[first_r[at] : first_r[at] + m.sum()]
        if whole * DENSE > (stop - at) * total.size:
            x, y = (np.zeros((stop - at, w), np.float32) for w in total.shape)
            x[np.repeat(np.arange(stop - at), n), own] = 1
            y[np.repeat(np.arange(stop - at), m), other] = 1
            total += (x.T @ y).astype(np.int64)
        elif whole:
            times = np.repeat(m, n)
            starts = np.repeat(np.cumsum(m) - m, n)
            inside = np.arange(whole) - np.repeat(np.cumsum(times) - times, times)
            keys = np.repeat(own.astype(np.int64) * width, times) + other[np.repeat(starts, times) + inside]
            total += np.bincount(keys, minlength=total.size).reshape(total.shape)
        at = stop


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def product_of_blocks(width: int):
    """The function that sums the products of item blocks i and j over one block of records. It holds a table of ``width`` squared
    counts and a batch of records at a time."""

    def product(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = key[0].as_py(), key[1].as_py()
        total = np.zeros((width, width), np.int64)
        for batch in batches:
            left, nl = _lists(batch.column(batch.schema.get_field_index("left")))
            right, nr = (left, nl) if i == j else _lists(batch.column(batch.schema.get_field_index("right")))
            transposed_product(total, left, nl, right, nr)
        x, y = np.nonzero(np.triu(total, 1) if i == j else total)
        cols = (x + (i << 32), y + (j << 32), total[x, y])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "n"])

    return product


def block_plan(octaves: dict[int, int], tile: int) -> dict[int, tuple[int, int]]:
    """First block and number of blocks for items of each octave of counts, the commonest items first.

    Octaves with few items share a block. As common items stand in the first blocks, most of a basket lies in few of them.
    """
    plan: dict[int, tuple[int, int]] = {}
    base, held, size = 0, [], 0
    for octave in sorted(octaves, reverse=True):
        held.append(octave)
        size += octaves[octave]
        if size >= tile or octave == min(octaves):
            n = -(-size // tile)
            plan |= {o: (base, n) for o in held}
            base, held, size = base + n, [], 0
    return plan


def item_table(cuts: Cuts, pairs: DataFrame, min_count: int, tile: int = TILE) -> DataFrame:
    """Items in at least ``min_count`` baskets: (item, n, block, code). An item's code is its place in its block, by name.

    The driver gets the number of items by octave of their counts, 64 numbers at most.
    """
    octave = F.floor(F.log2("n")).cast("int")
    counted = cuts.save("counted", pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))
    octaves = {r.o: r.k for r in counted.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("k")).collect()}
    plan = block_plan(octaves, tile) if octaves else {0: (0, 1)}
    base, many = (F.array(*(F.lit(plan.get(o, (0, 1))[k]) for o in range(64))) for k in (0, 1))
    block = F.get(base, octave) + F.pmod(F.xxhash64("item"), F.get(many, octave)).cast("int")
    code = F.row_number().over(Window.partitionBy("block").orderBy("item")) - 1
    return cuts.save("items", counted.withColumn("block", block).withColumn("code", code.cast("short")))


def gram(cuts: Cuts, entries: DataFrame, width: int, n_entries: int) -> DataFrame:
    """X'X above its diagonal from the ones (basket, block, code) of X: (a, b, n), n > 0, with a, b = block * 2^32 + code.

    Baskets are cut into item blocks, so no row is longer than a block. Blocks of one basket meet by a join on the basket, in
    which baskets of many blocks are spread; pairs of blocks go to the task of (i, j, block of records), which adds up the
    transposed products. There are as many blocks of records as keep a task's share near ``ENTRIES`` ones.
    """
    parts = cuts.save("parts", entries.groupBy("basket", "block").agg(F.collect_list("code").alias("codes")))
    rb = F.pmod(F.xxhash64("basket"), F.lit(max(1, -(-n_entries // ENTRIES)))).cast("int").alias("rb")
    same = parts.select(F.col("block").alias("i"), F.col("block").alias("j"), rb, F.col("codes").alias("left"), F.array().cast("array<short>").alias("right"))
    hot = hot_keys(parts, ["basket"])
    first = sliced(parts, hot, ["basket"], F.col("block")).select("basket", "_slice", F.col("block").alias("i"), F.col("codes").alias("left"))
    second = copied(parts, hot, ["basket"]).select("basket", "_slice", F.col("block").alias("j"), F.col("codes").alias("right"))
    other = first.join(second, ["basket", "_slice"]).where("i < j").select("i", "j", rb, "left", "right")
    return same.unionByName(other).groupBy("i", "j", "rb").applyInArrow(product_of_blocks(width), _GRAM).groupBy("a", "b").agg(F.sum("n").alias("n"))


def items_together(df: DataFrame, basket: Column, item: Column, min_count: int = 20, min_lift: float = 3.0, tile: int = TILE) -> DataFrame:
    """Pairs of items that share baskets, against what chance would give.

    Returns (item_a, item_b, n_ab, n_a, n_b, n_baskets, expected, lift) with item_a < item_b by bytes, for all pairs in at
    least ``min_count`` baskets with lift = n_ab * N / (n_a * n_b) >= ``min_lift``. A basket holds an item once, however often
    the row is repeated; rows where basket or item is null don't count. Empty input, or no such pair, gives no rows.
    Other columns of ``df`` have no influence.

    An item in fewer baskets than ``min_count`` can't be in a pair, so only the rest enters the matrix, in blocks of about
    ``tile`` items. The driver gets a few numbers. The distinct pairs, the items and the baskets' parts are written to the
    shared folder once, as each is read again.
    """
    min_count = max(1, min_count)
    cuts = Cuts(df.sparkSession, "together")
    named = df.select(basket.cast("string").alias("basket"), item.cast("string").alias("item")).where("basket is not null and item is not null")
    pairs = cuts.save("pairs", named.distinct())
    items = item_table(cuts, pairs, min_count, tile)
    size = items.agg(F.coalesce(F.max("code") + 1, F.lit(1)).alias("width"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    hot = items.where(F.col("n") >= share_of(F.lit(size.n), HOT)).select("item")
    kept = sliced(pairs, hot, ["item"], F.col("basket")).join(copied(items.select("item", "block", "code"), hot, ["item"]), ["item", "_slice"])
    counts = gram(cuts, kept.select("basket", "block", "code"), size.width, size.n).where(F.col("n") >= min_count)

    def side(s: str) -> DataFrame:
        return items.select((F.shiftleft(F.col("block").cast("long"), 32) + F.col("code")).alias(s), F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"))

    total = pairs.agg(F.count_distinct("basket")).scalar()
    swap = F.col("item_a") > F.col("item_b")

    def ordered(x: str, y: str) -> Column:
        return F.when(swap, F.col(y)).otherwise(F.col(x))

    joined = counts.join(side("a"), "a").join(side("b"), "b").select(
        ordered("item_a", "item_b").alias("item_a"), ordered("item_b", "item_a").alias("item_b"), F.col("n").alias("n_ab"),
        ordered("n_a", "n_b").alias("n_a"), ordered("n_b", "n_a").alias("n_b"), total.alias("n_baskets"),
    )
    chance = F.col("n_a").cast("double") * F.col("n_b") / F.col("n_baskets")
    wide = [F.col(c).cast("decimal(38,0)") for c in ("n_ab", "n_baskets", "n_a", "n_b")]
    if float(min_lift).is_integer():
        enough = wide[0] * wide[1] >= wide[2] * wide[3] * int(min_lift)
    else:
        enough = F.col("n_ab") >= min_lift * chance
    return joined.where(enough).withColumn("expected", chance).withColumn("lift", F.col("n_ab") / chance)

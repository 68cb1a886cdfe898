"""Parent-child links to full hierarchies: splitters, walks, a reduced pointer graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators.skew import census, hot_from, lookup_known
from cladewise.store import Cuts

#: One node in so many is a splitter.
EVERY = 6
_OPEN, _SPLITTER, _ROOT, _LONE = 0, 1, 2, 3


def current_links(rows: DataFrame, child: Column, parent: Column, length: Column, at: Column, tie: Column) -> DataFrame:
    """One current link per child: (node, parent, length), from the row with the latest ``at``, then the largest ``tie``.

    Rows without a child don't count; a null ``at`` is earlier than any other. A null parent makes the node a root. Lengths
    that are null, NaN, infinite or negative count as 0.
    """
    good = (length >= 0) & ~F.isnan(length) & (length < F.lit(float("inf")))
    last = F.max(F.struct(at.alias("at"), tie.alias("tie"), parent.alias("parent"), F.when(good, length.cast("double")).otherwise(0.0).alias("length")))
    named = rows.select(child.alias("node"), at.alias("_at"), "*").where("node is not null")
    return named.groupBy("node").agg(last.alias("x")).select("node", "x.parent", "x.length")


def _is_splitter(node: str, every: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(every)) == 0


class _Walk:
    """Pointers (node, ptr, state, path, length) that jump until they end.

    A round reads its table, joins the open rows and writes the next table. Its one other job counts the open rows and finds the
    targets that many of them share, which the next round spreads.
    """

    def __init__(self, cuts: Cuts, name: str, rows: DataFrame):
        self.cuts, self.name = cuts, name
        self.all = cuts.save(name, rows)

    @property
    def open(self) -> DataFrame:
        return self.all.where(F.col("state") == _OPEN)

    def settle(self, size: int) -> _Walk:
        """Jump until no open row gets anywhere.

        After r rounds every row within 2^r steps of its end has it. A row farther away has one on its way that is just one step
        farther, so a round that ends no row leaves only rows that never end: those on cycles and below. Their paths grow to
        twice the longest way that ends, at most.
        """
        n, hot = census(self.open, "ptr", hot_from(size))
        while n:
            going = self.open.select(F.col("node").alias("who"), F.col("ptr").alias("node"), F.col("path").alias("p"), F.col("length").alias("l"))
            step = lookup_known(going, self.all, "node", F.col("who"), hot).select(
                F.col("who").alias("node"), "ptr", "state", F.concat("p", "path").alias("path"), (F.col("l") + F.col("length")).alias("length")
            )
            self.all = self.cuts.save(self.name, self.all.where(F.col("state") != _OPEN).unionByName(step))
            left, hot = census(self.open, "ptr", hot_from(size))
            if left == n:
                break
            n = left
        return self


def cycle_keys(cuts: Cuts, name: str, edges: DataFrame) -> DataFrame:
    """The least name of the cycle that each node runs into: (node, cycle_key), from (node, ptr, low) where every ptr is a node.

    Other columns are kept. ``low`` is the least name that the step from the node passes. Pointers and minima are doubled. The set of nodes that are
    pointed at shrinks until it holds the cycles only; then minima must still span the longest possible cycle.
    """
    others = [c for c in edges.columns if c not in ("node", "ptr", "low")]
    state = cuts.save(name, edges.select("node", "ptr", "low", *others))
    size = state.count()
    if size == 0:
        return state.select("node", F.col("low").alias("cycle_key"), *others)
    targets, span = -1, 1
    while True:
        # one job: how many nodes are still pointed at, and which by many
        counted = state.groupBy("ptr").agg(F.count(F.lit(1)).alias("n"))
        seen = counted.agg(F.count(F.lit(1)).alias("now"), F.collect_list(F.when(F.col("n") >= hot_from(size), F.col("ptr"))).alias("hot")).first()
        now, hot = seen.now, seen.hot
        if now == targets and span >= now:
            break
        targets = now
        to = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("low2"))
        state = cuts.save(name, lookup_known(state, to, "ptr", F.col("node"), hot).select("node", F.col("next").alias("ptr"), F.least("low", "low2").alias("low"), *others))
        span *= 2
    to = state.select(F.col("node").alias("ptr"), F.col("low").alias("cycle_key"))
    return cuts.save(f"{name}-keys", lookup_known(state, to, "ptr", F.col("node"), hot).select("node", "cycle_key", *others))


def solve(spark: SparkSession, links: DataFrame, every: int = EVERY) -> DataFrame:
    """The way of every node to its root: (node, parent, way, root, length, cycle_key), from links as current_links gives them.

    ``way`` holds the names from the node up, without the root; ``length`` is the sum along it. Names that stand as a parent
    only are roots. Nodes whose parents run in a circle, or that hang below such a circle, have null way, root and length,
    and a ``cycle_key``: the least name on the circle. A node may be its own parent. Empty links give no rows.

    Every ``every``-th node by hash, and every root, is a splitter. All nodes walk to their next splitter by doubling jumps;
    such stretches are short, whatever the depth. The splitters alone, one node in ``every``, are then solved among
    themselves, and each node's path is its own stretch and that of its splitter. What never meets a splitter is on or below a
    cycle without one and is handled by itself; a splitter among it, on the tail of such a cycle, ends the walks from below,
    which take its key. Each round writes its table to the shared folder, so a lost executor costs
    one round at most. Parents of many nodes are spread in the joins. At the end the ways are counted against the nodes; a
    difference is an error.
    """
    cuts = Cuts(spark, "hierarchy")
    links = cuts.save("links", links)
    inner = links.where("parent is not null")
    size, hot = census(links, "parent", hot_from(links.count()))
    hot = [x for x in hot if x is not None]
    above = links.select(F.col("node").alias("parent"), F.col("parent").isNotNull().alias("inner"))
    state = F.when(F.col("inner").isNull() | ~F.col("inner"), _ROOT).when(_is_splitter("parent", every), _SPLITTER).otherwise(_OPEN)
    first = lookup_known(inner, above, "parent", F.col("node"), hot, "left").select("node", F.col("parent").alias("ptr"), state.alias("state"), F.array("node").alias("path"), "length")
    walk = _Walk(cuts, "walk", first).settle(size)
    walked = walk.all

    lone_end = F.col("state") == _OPEN
    ends = F.when(F.col("state") == _ROOT, _ROOT).when(lone_end, _LONE).otherwise(_OPEN)
    start = walked.where(_is_splitter("node", every)).select("node", F.when(lone_end, F.col("node")).otherwise(F.col("ptr")).alias("ptr"), ends.alias("state"), F.when(~lone_end, F.col("path")).alias("path"), "length")
    jumped = _Walk(cuts, "reduced", start).settle(size)
    reduced = jumped.all
    segments = walked.join(jumped.open.select("node"), "node", "left_semi").select("node", "ptr", F.array_min("path").alias("low"))
    # both kinds of circles in one run: splitters that never end, and nodes that never meet one; no node is both
    single = inner.join(walk.open.select("node"), "node", "left_semi").select("node", F.col("parent").alias("ptr"), F.col("node").alias("low"))
    keys = cycle_keys(cuts, "cycles", segments.withColumn("lone", F.lit(False)).unionByName(single.withColumn("lone", F.lit(True))))
    by_splitter, without = (keys.where(c).select("node", "cycle_key") for c in ("not lone", "lone"))

    by_lone = reduced.where(F.col("state") == _LONE).select("node", "ptr").join(without.select(F.col("node").alias("ptr"), "cycle_key"), "ptr").select("node", "cycle_key")
    keyed = by_splitter.unionByName(by_lone)
    over = reduced.where(F.col("state") == _ROOT).select(F.col("node").alias("ptr"), F.col("ptr").alias("top"), F.col("path").alias("rest"), F.col("length").alias("more"), F.lit(None).cast("string").alias("key"))
    over = over.unionByName(keyed.select(F.col("node").alias("ptr"), F.lit(None).cast("string").alias("top"), F.lit(None).cast("array<string>").alias("rest"), F.lit(None).cast("double").alias("more"), F.col("cycle_key").alias("key")))
    to_splitter = walked.where(F.col("state") == _SPLITTER)
    _, hot = census(to_splitter, "ptr", hot_from(size))
    via = lookup_known(to_splitter, over, "ptr", F.col("node"), hot).select(
        "node", F.concat("path", "rest").alias("way"), F.col("top").alias("root"), (F.col("length") + F.col("more")).alias("length"), F.col("key").alias("cycle_key")
    )
    none = F.lit(None).cast("string")
    straight = walked.where(F.col("state") == _ROOT).select("node", F.col("path").alias("way"), F.col("ptr").alias("root"), "length", none.alias("cycle_key"))
    alone = without.select("node", F.lit(None).cast("array<string>").alias("way"), none.alias("root"), F.lit(None).cast("double").alias("length"), "cycle_key")
    above_only = cuts.save("tops", inner.select(F.col("parent").alias("node")).distinct().join(links.select("node"), "node", "left_anti"))
    tops = links.where("parent is null").select("node").unionByName(above_only)
    roots = tops.select("node", F.array().cast("array<string>").alias("way"), F.col("node").alias("root"), F.lit(0.0).alias("length"), none.alias("cycle_key"))
    ways = cuts.save("ways", straight.unionByName(via).unionByName(alone).unionByName(roots))
    found, wanted = ways.count(), size + above_only.count()
    if found != wanted:
        raise RuntimeError(f"{wanted} nodes, but {found} ways")
    for name in ("walk", "reduced", "cycles", "cycles-keys", "tops"):
        cuts.drop(name)
    return ways.join(links.select("node", "parent"), "node", "left").select("node", "parent", "way", "root", "length", "cycle_key")


def ancestors(ways: DataFrame) -> DataFrame:
    """All pairs of a node and a node above it: (ancestor, descendant, distance); as many rows as the nodes are deep."""
    up = F.concat(F.slice("way", 2, F.greatest(F.size("way") - 1, F.lit(0))), F.array("root"))
    rows = ways.where("cycle_key is null and size(way) > 0").select(F.col("node").alias("descendant"), F.posexplode(up).alias("i", "ancestor"))
    return rows.select("ancestor", "descendant", (F.col("i") + 1).cast("long").alias("distance"))


def over_descendants(ways: DataFrame, value: Column, how: Callable[[Column], Column], every: int = EVERY) -> DataFrame:
    """(node, x) of nodes with descendants: ``how`` (F.sum, F.max, F.min) of ``value`` over these, without making all pairs of a node and
    one above it.

    A node counts for those up to the next splitter only. A splitter stands for itself and all below it there; its figure comes from the
    splitters above each splitter, one pair in about ``every`` squared. ``value`` is a column of ``ways``.
    """
    split = lambda x: F.pmod(F.xxhash64(x), F.lit(every)) == 0
    up = F.concat(F.slice("way", 2, F.greatest(F.size("way") - 1, F.lit(0))), F.array("root"))
    rows = ways.where("cycle_key is null and size(way) > 0").select("node", split(F.col("node")).alias("is_splitter"), up.alias("up"), value.alias("v"))
    first = F.array_position(F.transform("up", split), True)
    rows = rows.withColumn("near", F.when(first > 0, F.slice("up", 1, first.cast("int"))).otherwise(F.col("up")))
    # splitters with what ends at them, then with all splitters below
    own = rows.select(F.when(F.col("is_splitter"), F.col("node")).otherwise(F.element_at("near", -1)).alias("node"), "v").groupBy("node").agg(how(F.col("v")).alias("v"))
    chain = rows.where("is_splitter").select("node", F.concat(F.array("node"), F.filter("up", split)).alias("chain"))
    total = chain.join(own, "node").select(F.explode("chain").alias("node"), "v").groupBy("node").agg(how(F.col("v")).alias("total"))
    weighed = rows.join(total, "node", "left").select(F.explode("near").alias("node"), F.when(F.col("is_splitter"), F.col("total")).otherwise(F.col("v")).alias("v"))
    return weighed.groupBy("node").agg(how(F.col("v")).alias("x"))


def hierarchy(ways: DataFrame, every: int = EVERY) -> DataFrame:
    """(node, path, depth, root, length, n_descendants, cycle_key); a path runs from the root, joined by ``/``.

    Nodes on or below a circle have only their ``cycle_key``.
    """
    below = over_descendants(ways, F.lit(1), F.sum, every).withColumnRenamed("x", "n")
    ok = F.col("cycle_key").isNull()
    names = F.concat(F.array("root"), F.reverse("way"))
    path = F.array_join(F.when(F.size("way") == 0, F.array("root")).otherwise(names), "/")
    return ways.join(below, "node", "left").select(
        "node", F.when(ok, path).alias("path"), F.when(ok, F.size("way").cast("long")).alias("depth"), "root", "length",
        F.when(ok, F.coalesce("n", F.lit(0))).alias("n_descendants"), "cycle_key",
    )

"""Forests from edge lists: nodes, kinds, indices, branch bins, cliques."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.functions.prob import delta, uniform
from cladewise.operators import hierarchy

#: Rows that one window numbers; dense indices over more rows are made from block counts.
BLOCK = 1_000_000


class InvalidForest(ValueError):
    """An edge list that isn't a forest of positive branch lengths."""


def dense_index(df: DataFrame, order: str, name: str, groups: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... by the non-null integer column ``order`` within the groups.

    Rows are numbered inside blocks of ``order`` values, and blocks are offset by the counts of those before; the only window
    over a whole group runs over its blocks, one row per ``block`` values of ``order``.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    counts = rows.groupBy(*groups, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*groups, "_block", F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_block").orderBy(order)) - 1
    numbered = rows.withColumn("_in", inside).join(offsets, [*groups, "_block"])
    return numbered.withColumn(name, (F.col("_offset") + F.col("_in")).cast("long")).drop("_block", "_in", "_offset")


def edge_problems(edges: DataFrame) -> DataFrame:
    """What is wrong with an edge list: (problem, child, n), no rows for a good one.

    ``self_loop``, ``bad_length`` (null, NaN, infinite or not above 0), ``no_name`` (null child or parent), ``second_parent``.
    """
    ln = F.col("length")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("child") == F.col("parent"), "self_loop"),
            F.when(ln.isNull() | F.isnan(ln) | ~((ln > 0) & (ln < F.lit(float("inf")))), "bad_length"),
            F.when(F.col("child").isNull() | F.col("parent").isNull(), "no_name"),
        )
    )
    rows = edges.select("child", F.explode(kinds).alias("problem")).groupBy("problem", "child").agg(F.count(F.lit(1)).alias("n"))
    twice = edges.where("child is not null").groupBy("child").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.select("problem", "child", "n").unionByName(twice.select(F.lit("second_parent").alias("problem"), "child", "n"))


def validated(edges: DataFrame) -> DataFrame:
    """The edges, or InvalidForest with the first problems by name."""
    bad = edge_problems(edges).orderBy("problem", "child").limit(5).collect()
    if bad:
        raise InvalidForest("; ".join(f"{r.problem}: {r.child}" for r in bad))
    return edges


def node_order(edges: DataFrame) -> DataFrame:
    """(id, ord): nodes by first appearance, in a row the parent before the child. ``edges`` has (child, parent, length, ord)."""
    both = F.explode(F.array(F.struct(F.col("parent").alias("id"), (2 * F.col("ord")).alias("ord")), F.struct(F.col("child").alias("id"), (2 * F.col("ord") + 1).alias("ord"))))
    return edges.select(both.alias("x")).select("x.*").groupBy("id").agg(F.min("ord").alias("ord"))


def nodes(edges: DataFrame) -> DataFrame:
    """The node table: (id, parent, length, n_children, is_root, kind, node_ix, leaf_ix, internal_ix, root_ix, branch_ix).

    Kinds: ``leaf``, ``root``, ``internal``; roots are internal nodes too. Indices are dense in node order, null for nodes of
    another kind; roots have a null parent and length 0.
    """
    kids = edges.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    up = edges.select(F.col("child").alias("id"), "parent", "length")
    rows = node_order(edges).join(up, "id", "left").join(kids, "id", "left").fillna({"n_children": 0})
    rows = rows.withColumn("is_root", F.col("parent").isNull()).withColumn("length", F.coalesce("length", F.lit(0.0)))
    rows = rows.withColumn("kind", F.when(F.col("n_children") == 0, "leaf").when(F.col("is_root"), "root").otherwise("internal"))
    # all five indices follow the node order: blocks are counted once for all kinds, and blocks before are summed
    leaf, inner = F.col("kind") == "leaf", F.col("kind") != "leaf"
    flags = {"node_ix": F.lit(True), "leaf_ix": leaf, "internal_ix": inner, "root_ix": F.col("kind") == "root", "branch_ix": ~F.col("is_root")}
    rows = rows.withColumn("_block", F.floor(F.col("ord") / BLOCK))
    counts = rows.groupBy("_block").agg(*(F.count_if(flag).alias(name) for name, flag in flags.items()))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_block", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_{name}") for name in flags))
    inside = Window.partitionBy("_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.select("*", *(F.sum(flag.cast("long")).over(inside).alias(name) for name, flag in flags.items())).join(offsets, "_block")
    return numbered.select(
        "id", "parent", "length", "n_children", "is_root", "kind", *(F.when(flag, F.col(name) + F.col(f"_{name}") - 1).alias(name) for name, flag in flags.items())
    )


def node_counts(table: DataFrame) -> DataFrame:
    """(n_nodes, n_leaves, n_internals, n_roots, n_branches)."""
    kind = F.col("kind")
    return table.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(kind == "leaf").alias("n_leaves"), F.count_if(kind != "leaf").alias("n_internals"),
        F.count_if(kind == "root").alias("n_roots"), F.count_if(~F.col("is_root")).alias("n_branches"),
    )


def find_nodes(table: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows of the wanted ids, and the ids that aren't in the tree. ``wanted`` has (id)."""
    return wanted.join(table, "id"), wanted.join(table.select("id"), "id", "left_anti")


def leaf_ids(edges: DataFrame) -> DataFrame:
    """Children that are no parents."""
    return edges.select(F.col("child").alias("id")).distinct().join(edges.select(F.col("parent").alias("id")), "id", "left_anti")


def root_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("id")).distinct().join(edges.select(F.col("child").alias("id")), "id", "left_anti")


def depth_and_height(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, depth, height): steps from the root, and steps to the deepest node below; order by depth is breadth first, order by
    height has all children of a node before it."""
    ways = hierarchy.solve(spark, edges.select(F.col("child").alias("node"), "parent", "length"))
    deepest = hierarchy.over_descendants(ways, F.size("way"), F.max)
    depth = F.size("way").cast("long")
    return ways.join(deepest, "node", "left").select(F.col("node").alias("id"), depth.alias("depth"), F.coalesce(F.col("x") - depth, F.lit(0)).cast("long").alias("height"))


# -- branch lengths --------------------------------------------------------------------------------------------------------
def mean_positive(column: str = "length") -> Column:
    """Mean of the lengths above 0."""
    return F.avg(F.when(F.col(column) > 0, F.col(column)))


def normalised(branches: DataFrame) -> DataFrame:
    """Lengths divided by the mean of those above 0; the mean is one number, not a window over the tree."""
    mean = branches.agg(mean_positive()).scalar()
    return branches.withColumn("length", F.when(F.col("length") > 0, F.col("length") / mean).otherwise(F.col("length")))


def grid(spark: SparkSession, n_bins: int) -> DataFrame:
    """(grid_position, branch_length): the left edges of the bins."""
    return spark.range(n_bins).select(F.col("id").cast("int").alias("grid_position"), (F.col("id") * F.lit(delta(n_bins))).alias("branch_length"))


def bin_of(length: Column, n_bins: int) -> Column:
    """The first grid point that isn't below the length, the last bin beyond the grid.

    The grid is compared itself, since ceil(x / delta) errs where a length is a grid point.
    """
    d = F.lit(delta(n_bins))
    up = F.ceil(length / d).cast("int")
    fitted = F.when((up - 1) * d >= length, up - 1).when(up * d < length, up + 1).otherwise(up)
    return F.least(F.greatest(fitted, F.lit(0)), F.lit(n_bins - 1)).cast("int")


def binned(branches: DataFrame, n_bins: int) -> DataFrame:
    """Branches with their bin: (..., bin)."""
    return branches.withColumn("bin", bin_of(F.col("length"), n_bins))


def repaired_bins(branches: DataFrame, n_bins: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Bins moved until their sum is floor(n * n_bins / 2), as evenly as the bounds allow.

    With d the missing sum, every branch moves by as many whole steps as all can, and the first by ``order`` (a hash of the
    seed by default) by one more; branches at a bound can't move, so what is left is shared again. Each round settles at least
    the branches that reach a bound, and needs the counts by bin only, which decide how far all move.
    """
    counts = {int(r.bin): int(r.n) for r in branches.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, total = sum(counts.values()), sum(b * k for b, k in counts.items())
    missing = n * n_bins // 2 - total
    sign, steps = (1 if missing > 0 else -1), 0
    room = {b: (n_bins - 1 - b if sign > 0 else b) for b in counts}
    left = abs(missing)
    while left:
        able = sum(k for b, k in counts.items() if room[b] > steps)
        if able == 0 or able > left:
            break
        left, steps = left - able, steps + 1
    space = F.lit(n_bins - 1) - F.col("bin") if sign > 0 else F.col("bin")
    moved = branches.withColumn("bin", (F.col("bin") + sign * F.least(space, F.lit(steps))).cast("int"))
    if not left:
        return moved
    # a number of branches below all that can still move goes one step on: the first by hash
    free = F.col("bin") < n_bins - 1 if sign > 0 else F.col("bin") > 0
    keyed = moved.withColumn("_key", F.floor((order if order is not None else uniform("id", seed=seed)) * (2**52)).cast("long")).withColumn("_free", free)
    ranked = dense_index(keyed, "_key", "_rank", ("_free",), 2**44)
    return ranked.withColumn("bin", (F.col("bin") + F.when(F.col("_free") & (F.col("_rank") < left), sign).otherwise(0)).cast("int")).drop("_key", "_free", "_rank")


def bins_from_tree(table: DataFrame, n_bins: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Branches (no roots) with lengths of mean 1 and repaired bins."""
    return repaired_bins(binned(normalised(table.where("not is_root")), n_bins), n_bins, seed, order)


def bins_from_bins(branches: DataFrame, n_bins: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Bins from given bins: their midpoints scaled to mean 1, binned and repaired."""
    mids = branches.withColumn("length", F.lit(delta(n_bins)) * (F.col("bin") + F.lit(0.5)))
    return repaired_bins(binned(normalised(mids), n_bins), n_bins, seed, order)


# -- cliques ----------------------------------------------------------------------------------------------------------------
def cliques(table: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Cliques of a tree, one per combination of leaves of the other trees: (clique_ix, name, leaf_0, leaf_1, ...).

    With one other tree a clique is a leaf of it. With more, the product of their leaves is what the operator is to return.
    """
    out = None
    for k, other in enumerate(others):
        leaves = other.where("kind = 'leaf'").select(F.col("leaf_ix").alias(f"leaf_{k}"), F.col("id").alias(f"id_{k}"))
        if out is None:
            out = leaves
            continue
        size = leaves.count()
        grid_ = out.withColumn(f"leaf_{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
        out = grid_.join(leaves, f"leaf_{k}")
    ix, stride = F.lit(0).cast("long"), 1
    for k, other in enumerate(others):
        ix, stride = ix + F.col(f"leaf_{k}") * stride, stride * other.where("kind = 'leaf'").count() if k + 1 < len(others) else stride
    return out.select(ix.alias("clique_ix"), F.concat_ws("_", *(f"id_{k}" for k in range(len(others)))).alias("name"), *(f"leaf_{k}" for k in range(len(others))))


def clique_stride(sizes: list[int], dimension: int) -> int:
    """Distance of a clique's neighbouring leaves in the linear index: the product of the later dimensions."""
    out = 1
    for n in sizes[dimension + 1 :]:
        out *= n
    return out

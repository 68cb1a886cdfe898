"""Sparse binary matrices as DataFrames of stored cells: (r, c, state, n_ones).

A cell that isn't stored reads as false. Stored false cells stay until they are removed. Two states of one cell are an error that
``duplicate_cells`` finds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the largest count that a cell can hold; longer chains are thinned.
LARGEST_COUNT = 32_767
#: The columns of a part of a row, in which its runs are found by one task, and the cells that are made of a run at once.
PART, PIECE = 2**20, 2**13


@dataclass(frozen=True)
class Shape:
    """Dimensions and how often draws are counted."""

    n_rows: int
    n_cols: int
    n_iter: int = 1

    @property
    def size(self) -> int:
        return self.n_rows * self.n_cols

    @property
    def thinning(self) -> int:
        return max(1, -(-self.n_iter // LARGEST_COUNT))

    @property
    def total_counts(self) -> int:
        return self.n_iter // self.thinning


class OutOfBounds(ValueError):
    """A cell outside of the matrix."""


def linear(shape: Shape, r: str | Column = "r", c: str | Column = "c") -> Column:
    r, c = (F.col(x) if isinstance(x, str) else x for x in (r, c))
    return r.cast("long") * shape.n_cols + c


def row_col(shape: Shape, at: str | Column = "linear") -> tuple[Column, Column]:
    at = F.col(at) if isinstance(at, str) else at
    return F.floor(at / shape.n_cols).cast("long"), at % shape.n_cols


def within(df: DataFrame, shape: Shape) -> DataFrame:
    """The cells, or OutOfBounds if one lies outside."""
    bad = df.where(f"r < 0 or c < 0 or r >= {shape.n_rows} or c >= {shape.n_cols} or r is null or c is null").limit(1).collect()
    if bad:
        raise OutOfBounds(f"({bad[0].r}, {bad[0].c}) isn't in {shape.n_rows} x {shape.n_cols}")
    return df


def duplicate_cells(m: DataFrame) -> DataFrame:
    return m.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lookup_cells(m: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` (r, c, ...) with their state and count; false and 0 if not stored, and whether they are."""
    return cells.join(m.select("r", "c", "state", "n_ones", F.lit(True).alias("exists")), ["r", "c"], "left").fillna({"state": False, "n_ones": 0, "exists": False})


def set_states(m: DataFrame, updates: DataFrame) -> DataFrame:
    """New states (r, c, state) over old ones; counters stay, missing cells are stored with a count of 0."""
    new = updates.select("r", "c", F.col("state").alias("new"))
    return m.join(new, ["r", "c"], "full").select("r", "c", F.coalesce("new", "state").alias("state"), F.coalesce("n_ones", F.lit(0)).cast("int").alias("n_ones"))


def insert(m: DataFrame, cells: DataFrame, state: bool, shape: Shape) -> DataFrame:
    """Cells (r, c) stored with a state if they aren't yet; cells that are stay as they are."""
    new = within(cells, shape).select("r", "c").distinct().join(m.select("r", "c"), ["r", "c"], "left_anti")
    return m.unionByName(new.select("r", "c", F.lit(state).alias("state"), F.lit(0).alias("n_ones")))


def without_zeros(m: DataFrame) -> DataFrame:
    return m.where("state")


def without_counts(m: DataFrame) -> DataFrame:
    return m.withColumn("n_ones", F.lit(0))


def counted(m: DataFrame, iteration: int, shape: Shape) -> DataFrame:
    """One more draw: ones are counted if the iteration is a multiple of the thinning."""
    return m if iteration % shape.thinning else m.withColumn("n_ones", (F.col("n_ones") + F.col("state").cast("int")).cast("int"))


def fraction_of_ones(m: DataFrame, draws: int) -> DataFrame:
    """Adds the share of counted draws in which a cell was one; 0 without draws."""
    return m.withColumn("fraction", F.col("n_ones") / F.lit(float(draws)) if draws else F.lit(0.0))


def summary(m: DataFrame, shape: Shape) -> DataFrame:
    """(n_dims, total_size, n_stored, n_ones, sparsity, is_empty, thinning, total_counts)."""
    ones = F.count_if("state")
    return m.agg(F.count(F.lit(1)).alias("n_stored"), ones.alias("n_ones")).select(
        F.lit(2).alias("n_dims"), F.lit(shape.size).cast("long").alias("total_size"), "n_stored", "n_ones", (F.col("n_ones") / shape.size).alias("sparsity"),
        (F.col("n_stored") == 0).alias("is_empty"), F.lit(shape.thinning).alias("thinning"), F.lit(shape.total_counts).alias("total_counts"),
    )


def stored(m: DataFrame, shape: Shape) -> DataFrame:
    """Stored cells by rising linear index: a range-partitioned sort, for writers."""
    return m.withColumn("linear", linear(shape)).orderBy("linear")


def dense_runs(spark: SparkSession, m: DataFrame, shape: Shape) -> DataFrame:
    """The full grid in runs of equal cells: (r, c, n, state, exists, n_ones), ``n`` cells of a row from column ``c`` on.

    A stored cell is a run of one, and the cells between two stored ones are one run, so work goes with the stored cells and the rows.
    """
    n_parts = max(1, -(-shape.n_cols // PART))
    part = F.floor(F.col("c") / PART)
    starts = spark.range(shape.n_rows).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))).alias("part"))
    starts = starts.select("r", "part", (F.col("part") * PART - 1).alias("c"), F.lit(False).alias("state"), F.lit(0).alias("n_ones"), F.lit(False).alias("exists"))
    inside = (F.col("r") >= 0) & (F.col("r") < shape.n_rows) & (F.col("c") >= 0) & (F.col("c") < shape.n_cols)
    cells = m.where(inside).select(F.col("r").cast("long").alias("r"), part.alias("part"), F.col("c").cast("long").alias("c"), "state", F.col("n_ones").cast("int").alias("n_ones"), F.lit(True).alias("exists"))
    end = F.least((F.col("part") + 1) * PART, F.lit(shape.n_cols).cast("long"))
    following = F.coalesce(F.lead("c").over(Window.partitionBy("r", "part").orderBy("c")), end)
    rows = starts.unionByName(cells).select("*", following.alias("next"))
    own = F.when(F.col("exists"), F.struct("c", F.lit(1).cast("long").alias("n"), "state", "exists", "n_ones"))
    gap = F.struct((F.col("c") + 1).alias("c"), (F.col("next") - F.col("c") - 1).alias("n"), F.lit(False).alias("state"), F.lit(False).alias("exists"), F.lit(0).alias("n_ones"))
    return rows.select("r", F.explode(F.array(own, gap)).alias("x")).where("x.n > 0").select("r", "x.*")


def cells_of_runs(runs: DataFrame) -> DataFrame:
    """The runs' cells, each with the run's columns and its own ``c``; they are made in place, in the runs' order, and nothing is moved."""
    rest = [x for x in runs.columns if x not in ("c", "n")]
    pieces = runs.select(*rest, "n", F.col("c").alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("_at"))
    return pieces.select(*rest, F.explode(F.sequence(F.col("_c") + F.col("_at"), F.col("_c") + F.least(F.col("_at") + PIECE, F.col("n")) - 1)).alias("c"))


def densified(spark: SparkSession, m: DataFrame, shape: Shape, first: int = 0, last: int | None = None) -> DataFrame:
    """Cells first .. last - 1 of the full grid with their states: (linear, r, c, state, exists)."""
    end = shape.size if last is None else last
    at = linear(shape)
    low = F.greatest(F.lit(0).cast("long"), F.lit(first).cast("long") - at)
    runs = dense_runs(spark, m, shape).withColumn("_low", low).withColumn("n", F.least(F.col("n"), F.lit(end).cast("long") - at) - F.col("_low"))
    runs = runs.where("n > 0").withColumn("c", F.col("c") + F.col("_low"))
    return cells_of_runs(runs.select("r", "c", "n", "state", "exists")).select(at.alias("linear"), "r", "c", "state", "exists")


def row_window(spark: SparkSession, m: DataFrame, shape: Shape, row: int, start: int, k: int) -> DataFrame:
    """``k`` cells of a row from a column on: (linear, c, state, exists), cut at the row's end. The row filter reaches the scan."""
    cells = spark.range(start, min(start + k, shape.n_cols)).select(F.lit(row).cast("long").alias("r"), F.col("id").alias("c"))
    return lookup_cells(m.where(F.col("r") == row), cells).select(linear(shape).alias("linear"), "c", "state", "exists")


def column_window(spark: SparkSession, m: DataFrame, shape: Shape, column: int, start: int, k: int) -> DataFrame:
    """``k`` cells of a column from a row on: (linear, r, state, exists)."""
    cells = spark.range(start, min(start + k, shape.n_rows)).select(F.col("id").alias("r"), F.lit(column).cast("long").alias("c"))
    return lookup_cells(m.where(F.col("c") == column), cells).select(linear(shape).alias("linear"), "r", "state", "exists")


def switched(m: DataFrame) -> DataFrame:
    return m.withColumn("state", ~F.col("state"))


def is_empty_cell() -> Column:
    return ~F.col("state") & (F.col("n_ones") == 0)


def clique_states(y: DataFrame, z: DataFrame, table: DataFrame, own: str, other: str) -> DataFrame:
    """Stored states of a tree's cliques: (clique, id, state), leaves from Y and internal nodes from Z.

    ``y`` has (r, c, state) by leaf indices, ``z`` (internal_ix, other_ix, state); ``own`` and ``other`` name the columns of
    ``y`` that hold the tree's own leaves and the other tree's. Nodes that aren't stored read as false.
    """
    leaves = table.where("leaf_ix is not null").select(F.col("leaf_ix").alias(own), "id")
    inner = table.where("internal_ix is not null").select("internal_ix", "id")
    from_y = y.join(leaves, own).select(F.col(other).alias("clique"), "id", "state")
    return from_y.unionByName(z.join(inner, "internal_ix").select(F.col("other_ix").alias("clique"), "id", "state"))


def random_matrix(spark: SparkSession, shape: Shape, density: float, u: Column) -> DataFrame:
    """A Bernoulli matrix of ones; ``u`` is a uniform made from r and c."""
    r, c = row_col(shape, F.col("id"))
    cells = spark.range(shape.size).select(r.alias("r"), c.alias("c"))
    return cells.where(u < density).withColumns({"state": F.lit(True), "n_ones": F.lit(0)})

"""Writers of states, traces and scenarios, as folders of delimited or Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions.prob import delta
from cladewise.operators.sparse import Shape, cells_of_runs, dense_runs, linear, stored


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, on whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _named(df: DataFrame, rows: DataFrame, cols: DataFrame, names: tuple[str, str]) -> DataFrame:
    """``df`` (r, c, ...) with the names of both sides; name tables are (ix, id)."""
    left = rows.select(F.col("ix").alias("r"), F.col("id").alias(names[0]))
    right = cols.select(F.col("ix").alias("c"), F.col("id").alias(names[1]))
    return df.join(left, "r").join(right, "c")


def _in_order(runs: DataFrame, shape: Shape, rows: DataFrame, cols: DataFrame, names: tuple[str, str]) -> DataFrame:
    """All cells of runs with both names, by position: the runs are sorted, their cells are made in that order, and the names of the
    columns come by broadcast, so no cell is moved."""
    left = rows.select(F.col("ix").alias("r"), F.col("id").alias(names[0]))
    right = cols.select(F.col("ix").alias("c"), F.col("id").alias(names[1]))
    ordered = runs.join(left, "r").orderBy("r", "c")
    return cells_of_runs(ordered).join(F.broadcast(right), "c").withColumn("linear", linear(shape))


def y_dump(spark: SparkSession, y: DataFrame, shape: Shape, rows: DataFrame, cols: DataFrame, draws: int, full: bool) -> DataFrame:
    """(position, Y_state, species, molecules, fraction_of_one): all cells, or the stored ones by position."""
    names = ("species", "molecules")
    out = _in_order(dense_runs(spark, y, shape), shape, rows, cols, names) if full else _named(stored(y, shape), rows, cols, names)
    fraction = F.col("n_ones") / float(draws) if draws else F.lit(0.0)
    out = out.select(F.col("linear").alias("position"), F.col("state").cast("int").alias("Y_state"), "species", "molecules", fraction.alias("fraction_of_one"))
    return out if full else out.orderBy("position")


def y_dump_by_row(spark: SparkSession, y: DataFrame, shape: Shape, rows: DataFrame, draws: int) -> DataFrame:
    """(species, n_cells, first, last, n_ones, fractions): the full dump of Y summed by row, from its runs instead of its cells."""
    at, n = linear(shape), F.col("n")
    fraction = n * F.col("n_ones") / float(draws) if draws else F.lit(0.0)
    runs = dense_runs(spark, y, shape).join(rows.select(F.col("ix").alias("r"), F.col("id").alias("species")), "r")
    return runs.groupBy("species").agg(
        F.sum(n).alias("n_cells"), F.min(at).alias("first"), F.max(at + n - 1).alias("last"), F.sum(F.when(F.col("state"), n).otherwise(0)).alias("n_ones"), F.sum(fraction).alias("fractions")
    )


def z_dump(spark: SparkSession, z: DataFrame, shape: Shape, rows: DataFrame, cols: DataFrame, full: bool) -> DataFrame:
    """(species, molecules, position, Z_state); rows or columns are internal nodes, by the tree that ``z`` (r, c, state) belongs to."""
    m, names = z.select("r", "c", "state", F.lit(0).alias("n_ones")), ("species", "molecules")
    out = _in_order(dense_runs(spark, m, shape), shape, rows, cols, names) if full else _named(stored(m, shape), rows, cols, names)
    out = out.select("species", "molecules", F.col("linear").alias("position"), F.col("state").cast("int").alias("Z_state"))
    return out if full else out.orderBy("position")


def grid_dump(spark: SparkSession, n_bins: int) -> DataFrame:
    return spark.range(n_bins).select(F.col("id").cast("int").alias("grid_position"), (F.col("id") * F.lit(delta(n_bins))).alias("branch_length"))


def trace_rows(m: DataFrame, shape: Shape, iteration: int) -> DataFrame:
    """Ones of a draw in long form: (iteration, position). Cells that aren't there are zeros, so a draw takes as much room as it has ones."""
    return m.where("state").select(F.lit(iteration).alias("iteration"), linear(shape).alias("position"))


def append_trace(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def wide_trace(trace: DataFrame, positions: list[int]) -> DataFrame:
    """A few positions of a trace as columns, a row per iteration."""
    cols = [F.max((F.col("position") == p).cast("int")).alias(f"p{p}") for p in positions]
    return trace.groupBy("iteration").agg(*cols)


def link_dump(links: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(species, molecules) of links (r, c)."""
    return _named(links, rows, cols, ("species", "molecules")).select("species", "molecules")


def write_scenario(folder: str, trees: dict[str, DataFrame], papers: dict[str, DataFrame], parameters: DataFrame) -> None:
    """Trees (child, parent, length), paper counts (leaf, n) and parameters (name, value) of a scenario."""
    for name, edges in trees.items():
        write_table(edges.select("child", "parent", "length"), f"{folder}/{name}")
    for name, counts in papers.items():
        write_table(counts.select(F.col("leaf").alias(name), F.col("n").alias("number_of_papers")), f"{folder}/{name}_papers")
    write_table(parameters, f"{folder}/parameters", ",")

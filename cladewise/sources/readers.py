"""Readers of the text formats: white-space or tab separated tables with a header line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators.likelihood import kept_dimensions


class BadTable(ValueError):
    """A file whose columns aren't those that are needed."""


def table(spark: SparkSession, path: str, n_columns: int | None = None) -> DataFrame:
    """A text table split at any run of white space, as strings, with ``_row``, the place of the line in the data.

    Tabs, blanks and CR LF line ends may be mixed; blank lines don't count. ``_row`` orders lines of one file as they stand: it is made
    from the offset of the block and the place in it. A folder of parts that each have the header is read as one table.
    """
    lines = spark.read.text(path).withColumn("_row", F.monotonically_increasing_id()).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    parts = lines.select("_row", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("p"))
    first = parts.orderBy("_row").limit(1).collect()
    if not first:
        raise BadTable(f"{path} is empty")
    names = first[0].p
    if n_columns is not None and len(names) != n_columns:
        raise BadTable(f"{path} has {len(names)} columns, not {n_columns}")
    rows = parts.where(F.col("p") != F.array(*map(F.lit, names)))
    return rows.select("_row", *(F.try_element_at("p", F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent, length, ord) of a tree file: exactly three columns, whatever their names."""
    t = table(spark, path, 3)
    child, parent, length = [c for c in t.columns if c != "_row"]
    return t.select(F.col(child).alias("child"), F.col(parent).alias("parent"), F.expr(f"try_cast(`{length}` as double)").alias("length"), F.col("_row").alias("ord"))


def links(spark: SparkSession, path: str, trees: list[str]) -> DataFrame:
    """Names of links, one column per kept tree in the order of the trees; the header tells which are kept."""
    t = table(spark, path).drop("_row")
    keep = kept_dimensions(trees, t.columns)
    if keep != sorted(keep):
        raise BadTable(f"columns must stand in the order of the trees: {', '.join(trees)}")
    return t


def paper_counts(spark: SparkSession, path: str) -> DataFrame:
    """(leaf, n, ord); a negative count or one that isn't a number is an error."""
    t = table(spark, path, 2)
    leaf, n = [c for c in t.columns if c != "_row"]
    rows = t.select(F.col(leaf).alias("leaf"), F.expr(f"try_cast(`{n}` as long)").alias("n"), F.col("_row").alias("ord"))
    if rows.where("n is null or n < 0").limit(1).count():
        raise BadTable(f"{path} has counts that aren't whole numbers from 0 on")
    return rows


def y_state(spark: SparkSession, path: str) -> DataFrame:
    """(position, fraction): ones of a dump of five columns; position and state are the first two."""
    t = table(spark, path, 5)
    names = [c for c in t.columns if c != "_row"]
    return t.select(F.col(names[0]).cast("long").alias("position"), F.col(names[1]).cast("int").alias("state"), F.col(names[4]).cast("double").alias("fraction")).where("state = 1").drop("state")


def z_state(spark: SparkSession, path: str) -> DataFrame:
    """(position): ones of a dump of four columns; position and state are the last two."""
    t = table(spark, path, 4)
    names = [c for c in t.columns if c != "_row"]
    return t.select(F.col(names[2]).cast("long").alias("position"), F.col(names[3]).cast("int").alias("state")).where("state = 1").select("position")


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a comma or white-space separated file with a header."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"[,\s]+").alias("p"))
    return lines.select(F.element_at("p", 1).alias("name"), F.expr("try_cast(try_element_at(p, 2) as double)").alias("value")).where("value is not null")


def delimited(spark: SparkSession, path: str, columns: dict[str, str], sep: str = "\t") -> DataFrame:
    """Chosen columns of a delimited file with a header, cast; the others aren't parsed."""
    raw = spark.read.csv(path, sep=sep, header=True)
    return raw.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()))

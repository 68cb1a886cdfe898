"""Likelihood of observations: stored cells joined, all other cells as one term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions.prob import effort, log_count, p_link, safe_ln
from cladewise.operators.sparse import Shape


def occurrences(leaves: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, leaf_ix, occ): log(count + 1) per leaf, 0 without a count; ``papers`` has (leaf, n, ord), the last row of a leaf holds."""
    last = papers.where("leaf is not null").groupBy(F.col("leaf").alias("id")).agg(F.max_by("n", "ord").alias("n"))
    return leaves.where("kind = 'leaf'").join(last, "id", "left").select("id", "leaf_ix", log_count("n").alias("occ"))


def effort_table(occ: DataFrame, gamma: float, name: str) -> DataFrame:
    """(leaf_ix, name): the effort factor of each leaf, computed once per leaf and not per cell."""
    return occ.select("leaf_ix", effort(gamma, "occ").alias(name))


def links_of_names(names: DataFrame, species: DataFrame, molecules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (r, c), distinct, of names (species, molecules); and the names that are no leaves, (species, molecules, is_species, is_molecule)."""
    left = species.where("kind = 'leaf'").select(F.col("id").alias("species"), F.col("leaf_ix").alias("r"))
    right = molecules.where("kind = 'leaf'").select(F.col("id").alias("molecules"), F.col("leaf_ix").alias("c"))
    both = names.join(left, "species", "left").join(right, "molecules", "left")
    good = both.where("r is not null and c is not null").select("r", "c").distinct()
    bad = both.where("r is null or c is null").select("species", "molecules", F.col("r").isNotNull().alias("is_species"), F.col("c").isNotNull().alias("is_molecule")).distinct()
    return good, bad


def visited(y: DataFrame, links: DataFrame) -> DataFrame:
    """Cells stored in either matrix: (r, c, x, link)."""
    return y.select("r", "c", "state").join(links.select("r", "c", F.lit(True).alias("link")), ["r", "c"], "full").select(
        "r", "c", F.coalesce("state", F.lit(False)).alias("x"), F.coalesce("link", F.lit(False)).alias("link")
    )


def cell_probabilities(cells: DataFrame, efforts_r: DataFrame, efforts_c: DataFrame, epsilon: float | Column, simple: bool = False) -> DataFrame:
    """Adds ``p`` = P(link | x); effort tables are (leaf_ix, effort_r) and (leaf_ix, effort_c)."""
    if simple:
        return cells.withColumn("p", p_link("x", "link", None, epsilon, True))
    rows = cells.join(efforts_r.withColumnRenamed("leaf_ix", "r"), "r").join(efforts_c.withColumnRenamed("leaf_ix", "c"), "c")
    return rows.withColumn("p", p_link("x", "link", F.col("effort_r") * F.col("effort_c"), epsilon)).drop("effort_r", "effort_c")


def link_log_likelihood(y: DataFrame, links: DataFrame, efforts_r: DataFrame, efforts_c: DataFrame, shape: Shape, epsilon: float, simple: bool = False) -> DataFrame:
    """(n_visited, log_likelihood): the sum over stored cells, and one term for all cells that neither matrix stores."""
    rows = cell_probabilities(visited(y, links), efforts_r, efforts_c, epsilon, simple)
    bulk = F.ln(F.lit(1 - epsilon)) * (F.lit(float(shape.size)) - F.count(F.lit(1)))
    return rows.agg(F.count(F.lit(1)).alias("n_visited"), (F.coalesce(F.sum(safe_ln("p")), F.lit(0.0)) + bulk).alias("log_likelihood"))


def log_likelihood_ratio(y: DataFrame, links: DataFrame, occ_r: DataFrame, occ_c: DataFrame, shape: Shape, old: tuple[float, float, float], new: tuple[float, float, float]) -> DataFrame:
    """(log_ratio) of the links for two settings (gamma of rows, gamma of columns, epsilon), in one pass over the cells."""
    cells = visited(y, links).join(occ_r.select(F.col("leaf_ix").alias("r"), F.col("occ").alias("occ_r")), "r").join(occ_c.select(F.col("leaf_ix").alias("c"), F.col("occ").alias("occ_c")), "c")

    def ln_p(s: tuple[float, float, float]) -> Column:
        return safe_ln(p_link("x", "link", effort(s[0], "occ_r") * effort(s[1], "occ_c"), s[2]))

    bulk = (F.ln(F.lit(1 - new[2])) - F.ln(F.lit(1 - old[2]))) * (F.lit(float(shape.size)) - F.count(F.lit(1)))
    return cells.agg((F.coalesce(F.sum(ln_p(new) - ln_p(old)), F.lit(0.0)) + bulk).alias("log_ratio"))


# -- collapsed dimensions ---------------------------------------------------------------------------------------------------
def kept_dimensions(trees: list[str], keep: list[str]) -> list[int]:
    """Positions of the kept trees; the errors of an impossible choice."""
    if len(keep) > len(trees):
        raise ValueError(f"more dimensions ({len(keep)}) than trees ({len(trees)})")
    if not keep:
        raise ValueError("no dimension is kept")
    unknown = [k for k in keep if k not in trees]
    if unknown:
        raise ValueError(f"no tree is called {unknown[0]!r}")
    if len(set(keep)) < len(keep):
        raise ValueError("a dimension is named twice")
    if keep[-1] != trees[-1]:
        raise ValueError(f"the last dimension must be {trees[-1]!r}")
    return [trees.index(k) for k in keep]


def collapsed(y: DataFrame, keep: list[str]) -> DataFrame:
    """Cells of the kept index columns: (keep..., x, n_ones), x if any of the collapsed cells is one."""
    return y.groupBy(*keep).agg(F.bool_or("state").alias("x"), F.count_if("state").alias("n_ones"))


def collapsed_without_self(y: DataFrame, keep: list[str]) -> DataFrame:
    """Each stored cell with ``x_without``: whether any other cell that collapses to the same place is one."""
    totals = collapsed(y, keep).select(*keep, F.col("n_ones").alias("_n"))
    return y.join(totals, keep).withColumn("x_without", F.col("_n") - F.col("state").cast("int") > 0).drop("_n")


def expanded(cells: DataFrame, trees: list[str], keep: list[str]) -> DataFrame:
    """Kept index columns put back among all dimensions, 0 for collapsed ones."""
    return cells.select(*(F.col(t) if t in keep else F.lit(0).alias(t) for t in trees), *(c for c in cells.columns if c not in trees))


def collapsed_log_likelihood(y: DataFrame, links: DataFrame, keep: list[str], size: int, efforts: DataFrame, effort_key: str, epsilon: float) -> DataFrame:
    """(n_visited, log_likelihood) where some dimensions are collapsed to "any of them"; all cells count, not only those up to
    the last link."""
    x = collapsed(y, keep).select(*keep, "x")
    rows = x.join(links.select(*keep).distinct().withColumn("link", F.lit(True)), keep, "full").fillna({"x": False, "link": False})
    rows = rows.join(efforts.select(F.col("leaf_ix").alias(effort_key), F.col("effort")), effort_key)
    bulk = F.ln(F.lit(1 - epsilon)) * (F.lit(float(size)) - F.count(F.lit(1)))
    return rows.agg(F.count(F.lit(1)).alias("n_visited"), (F.coalesce(F.sum(safe_ln(p_link("x", "link", F.col("effort"), epsilon))), F.lit(0.0)) + bulk).alias("log_likelihood"))

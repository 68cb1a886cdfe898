"""Synthetic trees, counts and edges; all depend on indices and seeds, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions.prob import uniform

#: Fixed value: the length of every generated branch.
BRANCH = 0.2


def _edges(df: DataFrame, child: Column, parent: Column) -> DataFrame:
    return df.select(child.alias("child"), parent.alias("parent"), F.lit(BRANCH).alias("length"), F.col("id").alias("ord"))


def grass(spark: SparkSession, name: str, n_nodes: int) -> DataFrame:
    """As many roots with one leaf each as half the nodes."""
    if n_nodes < 2 or n_nodes % 2:
        raise ValueError("grass needs an even number of nodes, 2 or more")
    return _edges(spark.range(n_nodes // 2), F.concat(F.lit(f"{name}_leaf_"), "id"), F.concat(F.lit(f"{name}_root_"), "id"))


def star(spark: SparkSession, name: str, n_nodes: int) -> DataFrame:
    """One root, all others its leaves."""
    if n_nodes < 3:
        raise ValueError("a star needs 3 nodes or more")
    return _edges(spark.range(1, n_nodes), F.concat(F.lit(f"{name}_"), "id"), F.lit(f"{name}_0"))


def balanced(spark: SparkSession, name: str, n_nodes: int) -> DataFrame:
    """A full binary tree: the parent of node i is (i - 1) div 2."""
    if n_nodes < 3 or (n_nodes + 1) & n_nodes:
        raise ValueError("a balanced tree needs 2^k - 1 nodes, 3 or more")
    return _edges(spark.range(1, n_nodes), F.concat(F.lit(f"{name}_"), "id"), F.concat(F.lit(f"{name}_"), F.floor((F.col("id") - 1) / 2)))


TREES = {"grass": grass, "star": star, "balanced": balanced}


def poisson_steps(mean: float, most: int = 64) -> list[float]:
    """The cumulative probabilities of 0, 1, ... most - 1."""
    out, p, total = [], math.exp(-mean), 0.0
    for k in range(most):
        total += p
        p *= mean / (k + 1)
        out.append(total)
    return out


def poisson(u: Column, mean: float, most: int = 64) -> Column:
    """A Poisson number by inversion of one uniform: how many cumulative probabilities lie below it."""
    return F.size(F.filter(F.array(*(F.lit(c) for c in poisson_steps(mean, most))), lambda c: c < u)).cast("long")


def poisson_counts(leaves: DataFrame, mean: float = 4.0, seed: int = 0, u: Column | None = None) -> DataFrame:
    """(leaf, n): Poisson paper counts per leaf id, without zeros."""
    return leaves.select(F.col("id").alias("leaf"), poisson(uniform("id", seed=seed) if u is None else u, mean).alias("n")).where("n > 0")


def beta_2_3(*keys: Column | str | int, seed: int) -> Column:
    """Beta(2, 3): the second least of four uniforms."""
    return F.element_at(F.array_sort(F.array(*(uniform(*keys, seed=seed + k) for k in range(4)))), 2)


def bipartite_edges(spark: SparkSession, n_features: int, n_molecules: int, mean_candidates: float, seed: int = 0) -> DataFrame:
    """(feature, molecule, score): a Poisson number of candidates per feature, at least one, with Beta(2, 3) scores of six digits."""
    n = F.greatest(poisson(uniform("id", seed=seed), mean_candidates), F.lit(1))
    rows = spark.range(n_features).select("id", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("k"))
    molecule = F.floor(uniform("id", "k", seed=seed + 1) * n_molecules).cast("long")
    made = rows.select(F.concat(F.lit("F"), "id").alias("feature"), F.concat(F.lit("M"), molecule).alias("molecule"), F.round(beta_2_3("id", "k", seed=seed + 2), 6).alias("score"))
    return made.where("score > 0").groupBy("feature", "molecule").agg(F.max("score").alias("score"))

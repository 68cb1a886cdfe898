"""Reports on states, parameters and posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions.prob import uniform


def transition_density(edges: DataFrame, states: DataFrame) -> DataFrame:
    """How often a child's state differs from its parent's, over the branches and cliques whose two states are given.

    ``edges`` (child, parent), ``states`` (node, clique, state). Returns one row: (n_cliques, n_branches, n_leaf_branches, n_internal_branches,
    matched_pairs, coverage, density_overall, density_leaf, density_internal); a mean over nothing is null.
    """
    leaves = edges.select("child").join(edges.select(F.col("parent").alias("child")), "child", "left_anti").distinct().withColumn("leaf", F.lit(True))
    marked = edges.select("child", "parent").join(leaves, "child", "left").fillna({"leaf": False})
    own = states.select(F.col("node").alias("child"), "clique", F.col("state").alias("state_child"))
    up = states.select(F.col("node").alias("parent"), "clique", F.col("state").alias("state_parent"))
    full = marked.join(own, "child").join(up, ["parent", "clique"])
    differs = (F.col("state_child") != F.col("state_parent")).cast("double")
    n_cliques = states.agg(F.count_distinct("clique")).scalar()
    n_branches, n_leaf = marked.agg(F.count(F.lit(1))).scalar(), marked.agg(F.count_if("leaf")).scalar()
    return full.agg(
        F.count(F.lit(1)).alias("matched_pairs"), F.avg(differs).alias("density_overall"),
        F.avg(F.when(F.col("leaf"), differs)).alias("density_leaf"), F.avg(F.when(~F.col("leaf"), differs)).alias("density_internal"),
    ).select(
        n_cliques.alias("n_cliques"), n_branches.alias("n_branches"), n_leaf.alias("n_leaf_branches"), (n_branches - n_leaf).alias("n_internal_branches"),
        "matched_pairs", F.try_divide(F.col("matched_pairs"), n_branches * n_cliques).alias("coverage"), "density_overall", "density_leaf", "density_internal",
    )


def with_predictions(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(position, truth, predicted): 0 where nothing was predicted."""
    return truth.select("position", "truth").join(predicted.select("position", "predicted"), "position", "left").fillna({"predicted": 0.0})


def agreement(pairs: DataFrame) -> DataFrame:
    """(n, mae, mse, pearson, cosine) of truth and prediction; null correlation where one of them is constant."""
    t, p = F.col("truth").cast("double"), F.col("predicted").cast("double")
    dot, tt, pp = F.sum(t * p), F.sum(t * t), F.sum(p * p)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(t - p)).alias("mae"), F.avg(F.pow(t - p, 2)).alias("mse"), F.corr(t, p).alias("pearson"), F.try_divide(dot, F.sqrt(tt) * F.sqrt(pp)).alias("cosine"))


def calibration(pairs: DataFrame, n_bins: int = 10) -> DataFrame:
    """(bin, n, mean_predicted, mean_truth): empirical frequency by bin of the predicted probability."""
    b = F.least(F.floor(F.col("predicted") * n_bins), F.lit(n_bins - 1)).cast("int")
    return pairs.groupBy(F.greatest(b, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("mean_predicted"), F.avg(F.col("truth").cast("double")).alias("mean_truth"))


def true_against_inferred(truth: DataFrame, posterior: DataFrame) -> DataFrame:
    """(name, value, post_mean, post_var, post_sd) of parameters that both have."""
    sd = F.sqrt(F.greatest(F.col("post_var"), F.lit(0.0)))
    return truth.join(posterior, "name").select("name", "value", "post_mean", "post_var", sd.alias("post_sd"))


def subsample(df: DataFrame, n: int, *keys: str, seed: int = 0, u: Column | None = None) -> DataFrame:
    """``n`` rows without replacement: those with the least hash of their keys, or the least ``u``. Spark keeps n rows per task for this."""
    return df.withColumn("_u", uniform(*keys, seed=seed) if u is None else u).orderBy("_u", *keys).limit(n).drop("_u")

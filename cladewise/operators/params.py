"""Parameters of the model: initial values, priors, Metropolis-Hastings steps, traces."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.functions import prob as P
from cladewise.operators.field import sparse_log_likelihood

#: The priors and starting points of the model.
PRIORS = {"gamma": ("gamma", 2.0, 4.6), "epsilon": ("beta", 0.3, 5.0), "mean_log_nu": ("normal", 0.0, 2.0), "var_log_nu": ("exponential", 1.0), "contamination": ("beta", 0.3, 5.0)}
START = {"alpha": 0.5, "log_nu": 0.0, "log_nu_sd": 0.1, "gamma": 5.0, "epsilon": 0.001, "filter_index": 128, "contamination": 0.001}


def ln_prior(name: str, x: Column) -> Column:
    """Log-density of a parameter's prior; parameters without one are uniform."""
    kind, *args = PRIORS.get(name, ("uniform",))
    if kind == "gamma":
        return P.ln_gamma_density(x, *args)
    if kind == "beta":
        return P.ln_beta_density(x, *args)
    if kind == "normal":
        return P.ln_normal_density(x, F.lit(args[0]), F.lit(args[1]))
    return P.ln_exponential_density(x, *args) if kind == "exponential" else F.lit(0.0)


def ln_prior_of(name: str, x: float) -> float:
    """The same for one number, where the driver decides about a single parameter."""
    kind, *a = PRIORS.get(name, ("uniform",))
    if kind == "gamma":
        return a[0] * math.log(a[1]) - math.lgamma(a[0]) + (a[0] - 1) * math.log(x) - a[1] * x if x > 0 else -math.inf
    if kind == "beta":
        return math.lgamma(a[0] + a[1]) - math.lgamma(a[0]) - math.lgamma(a[1]) + (a[0] - 1) * math.log(x) + (a[1] - 1) * math.log1p(-x) if 0 < x < 1 else -math.inf
    if kind == "normal":
        return -0.5 * math.log(2 * math.pi * a[1]) - (x - a[0]) ** 2 / (2 * a[1])
    if kind == "exponential":
        return math.log(a[0]) - a[0] * x if x >= 0 else -math.inf
    return 0.0


def initial_cliques(cliques: DataFrame, seed: int = 0, sd: float = START["log_nu_sd"]) -> DataFrame:
    """(clique, alpha, log_nu, nu) at the start: alpha 0.5 and log_nu from a narrow normal around 0, by clique and seed."""
    log_nu = START["log_nu"] + sd * P.normal("clique", seed=seed)
    return cliques.select("clique", F.lit(START["alpha"]).alias("alpha"), log_nu.alias("log_nu")).withColumn("nu", F.exp("log_nu"))


def simulated_cliques(cliques: DataFrame, mean: float, var: float, seed: int = 0) -> DataFrame:
    """(clique, alpha, log_nu, nu) from the prior: alpha uniform, log_nu normal."""
    log_nu = mean + math.sqrt(var) * P.normal("clique", seed=seed + 1)
    return cliques.select("clique", P.uniform("clique", seed=seed).alias("alpha"), log_nu.alias("log_nu")).withColumn("nu", F.exp("log_nu"))


def proposed_alpha(cliques: DataFrame, step: float, seed: int, iteration: int, z: Column | None = None) -> DataFrame:
    """A random walk reflected at 0 and 1: adds ``alpha_try``. ``z`` takes the place of the standard normal number."""
    x = F.col("alpha") + step * (P.normal("clique", iteration, seed=seed) if z is None else z)
    folded = F.abs(x) % 2.0
    return cliques.withColumn("alpha_try", F.when(folded > 1, 2 - folded).otherwise(folded)).withColumn("nu_try", F.col("nu"))


def proposed_log_nu(cliques: DataFrame, step: float, seed: int, iteration: int, z: Column | None = None) -> DataFrame:
    x = F.col("log_nu") + step * (P.normal("clique", iteration, seed=seed + 2) if z is None else z)
    return cliques.withColumn("log_nu_try", x).withColumn("nu_try", F.exp("log_nu_try")).withColumn("alpha_try", F.col("alpha"))


def decide_cliques(cliques: DataFrame, ratios: DataFrame, name: str, seed: int, iteration: int, mean: float = 0.0, var: float = 1.0, u: Column | None = None) -> DataFrame:
    """Cliques after the step: a proposal is taken by its likelihood ratio, and for log_nu by the ratio of its normal prior.

    ``ratios`` has (clique, cur, try); cliques without branches there keep a ratio of 0.
    """
    ratio = F.coalesce(F.col("try") - F.col("cur"), F.lit(0.0))
    if name == "log_nu":
        ratio = ratio + P.ln_normal_density("log_nu_try", F.lit(mean), F.lit(var)) - P.ln_normal_density("log_nu", F.lit(mean), F.lit(var))
    took = P.accepted(ratio, P.uniform("clique", iteration, seed=seed + 3) if u is None else u)
    new = F.when(took, F.col(f"{name}_try")).otherwise(F.col(name))
    rows = cliques.join(ratios, "clique", "left").withColumn("accepted", took).withColumn(name, new)
    return rows.select("clique", "alpha", "log_nu", F.exp("log_nu").alias("nu"), "accepted")


def clique_ratios(touched: DataFrame, tries: DataFrame, counts: list[int]) -> DataFrame:
    """(clique, cur, try) of proposals (clique, alpha, nu, alpha_try, nu_try), from touched_branches or touched_counts, and bulk_counts."""
    rows = touched.join(tries.select("clique", "alpha_try", "nu_try"), "clique")
    return sparse_log_likelihood(rows, tries, counts, F.col("alpha_try"), F.col("nu_try"))


# -- mean and variance of log_nu -----------------------------------------------------------------------------------------------------
def log_nu_moments(cliques: DataFrame) -> tuple[int, float, float]:
    """Number, sum and sum of squares of log_nu: all that its mean and variance depend on."""
    r = cliques.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("log_nu"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("log_nu") * F.col("log_nu")), F.lit(0.0)).alias("q")).first()
    return r.n, r.s, r.q


def hyper_log_ratio(moments: tuple[int, float, float], old: tuple[float, float], new: tuple[float, float]) -> float:
    """Log posterior of (mean, variance) of log_nu, new less old, given the moments."""

    def posterior(mean: float, var: float) -> float:
        n, s, q = moments
        likelihood = -0.5 * n * math.log(2 * math.pi * var) - (q - 2 * mean * s + n * mean * mean) / (2 * var)
        return likelihood + ln_prior_of("mean_log_nu", mean) + ln_prior_of("var_log_nu", var)

    return posterior(*new) - posterior(*old)


def updated_hyper(moments: tuple[int, float, float], mean: float, var: float, steps: tuple[float, float], rng) -> tuple[float, float]:
    """Mean and variance of log_nu after a Metropolis-Hastings step each; a variance is reflected at 0."""
    for tried in ((mean + steps[0] * rng.standard_normal(), None), (None, steps[1] * rng.standard_normal())):
        new = (tried[0], var) if tried[1] is None else (mean, abs(var + tried[1]))
        if new[1] > 0 and math.log(rng.random()) < hyper_log_ratio(moments, (mean, var), new):
            mean, var = new
    return mean, var


# -- branch bins ---------------------------------------------------------------------------------------------------------------
def branch_pairs(branches: DataFrame, seed: int, iteration: int, buckets: int = 64) -> DataFrame:
    """Branches (id, bin) in disjoint random pairs: (pair, id, bin, first). One branch at most stays alone.

    Order is by a hash of id, seed and iteration; neighbours in a hash bucket are paired, so no window sees the whole tree. What
    is left over in buckets of odd size, one branch each, is paired in a second round.
    """
    key = P.uniform("id", iteration, seed=seed)
    rows = branches.select("id", "bin", key.alias("_u")).withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    by = Window.partitionBy("_b")
    rows = rows.withColumn("_k", F.row_number().over(by.orderBy("_u", "id")) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    alone = (F.col("_n") % 2 == 1) & (F.col("_k") == F.col("_n") - 1)
    met = rows.where(~alone).select(F.concat_ws("-", "_b", F.floor(F.col("_k") / 2)).alias("pair"), "id", "bin", (F.col("_k") % 2 == 0).alias("first"))
    # at most one row per bucket
    rest = rows.where(alone).withColumn("_r", F.row_number().over(Window.orderBy("_u", "id")) - 1).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
    rest = rest.where((F.col("_m") % 2 == 0) | (F.col("_r") < F.col("_m") - 1))
    return met.unionByName(rest.select(F.concat_ws("-", F.lit("rest"), F.floor(F.col("_r") / 2)).alias("pair"), "id", "bin", (F.col("_r") % 2 == 0).alias("first")))


def pair_moves(pairs: DataFrame, n_bins: int, seed: int, iteration: int, u: Column | None = None) -> DataFrame:
    """(pair, id_1, id_2, bin_1, bin_2, move): one bin goes up, the other down, so the sum stays.

    Of the steps -1 and +1 of the first bin those are allowed that keep both bins on the grid; one of them is drawn by ``u``, a
    uniform of the pair, and 0 stands where none is.
    """
    top = n_bins - 1

    def side(flag: Column, name: str) -> Column:
        return F.max(F.when(flag, F.col(name)))

    wide = pairs.groupBy("pair").agg(side(F.col("first"), "id").alias("id_1"), side(~F.col("first"), "id").alias("id_2"), side(F.col("first"), "bin").alias("bin_1"), side(~F.col("first"), "bin").alias("bin_2"))
    down = F.when((F.col("bin_1") > 0) & (F.col("bin_2") < top), F.lit(-1))
    up = F.when((F.col("bin_1") < top) & (F.col("bin_2") > 0), F.lit(1))
    allowed = F.array_compact(F.array(down, up))
    drawn = F.get(allowed, F.floor((P.uniform("pair", iteration, seed=seed + 5) if u is None else u) * F.size(allowed)).cast("int"))
    return wide.withColumn("move", F.coalesce(drawn, F.lit(0)).cast("int"))


def pair_ratios(moves: DataFrame, rows: DataFrame, n_bins: int) -> DataFrame:
    """(pair, log_ratio): sum over cliques of ln P(new bin) - ln P(old bin) of both branches; ``rows`` as all_branches gives them.

    The ratio of one branch is summed over its cliques before the two of a pair meet.
    """
    both = moves.select("pair", F.explode(F.array(F.struct(F.col("id_1").alias("id"), F.col("move").alias("by")), F.struct(F.col("id_2").alias("id"), (-F.col("move")).alias("by")))).alias("x")).select("pair", "x.*")
    met = rows.join(both, "id")
    old = P.transition_to("parent_state", "state", P.transition("alpha", "nu", "bin", n_bins))
    new = P.transition_to("parent_state", "state", P.transition("alpha", "nu", F.col("bin") + F.col("by"), n_bins))
    return met.groupBy("pair", "id").agg(F.sum(P.safe_ln(new) - P.safe_ln(old)).alias("d")).groupBy("pair").agg(F.sum("d").alias("log_ratio"))


def sparse_pair_ratios(moves: DataFrame, touched: DataFrame, cliques: DataFrame, n_bins: int) -> DataFrame:
    """As pair_ratios, from touched_branches: cliques that don't touch a branch are one sum per bin, from a single pass over the cliques."""
    sums = cliques.agg(*(F.sum(P.safe_ln(P.transition("alpha", "nu", F.lit(b), n_bins)["p00"])).alias(f"s_{b}") for b in range(n_bins))).first()
    all_of = F.array(*(F.lit(float(sums[f"s_{b}"] or 0.0)) for b in range(n_bins)))
    both = moves.select("pair", F.explode(F.array(F.struct(F.col("id_1").alias("id"), F.col("bin_1").alias("bin"), F.col("move").alias("by")), F.struct(F.col("id_2").alias("id"), F.col("bin_2").alias("bin"), (-F.col("move")).alias("by")))).alias("x")).select("pair", "x.*")
    met = touched.drop("bin").join(both, "id")
    to = F.col("bin") + F.col("by")

    def ln(bin_: Column, state: bool) -> Column:
        p = P.transition("alpha", "nu", bin_, n_bins)
        return P.safe_ln(P.transition_to("parent_state", "state", p) if state else p["p00"])

    seen = met.groupBy("pair", "id").agg(F.sum(ln(to, True) - ln(F.col("bin"), True) - ln(to, False) + ln(F.col("bin"), False)).alias("d"))
    rest = F.get(all_of, to) - F.get(all_of, F.col("bin"))
    return both.join(seen, ["pair", "id"], "left").groupBy("pair").agg(F.sum(rest + F.coalesce("d", F.lit(0.0))).alias("log_ratio"))


def state_pair_ratios(moves: DataFrame, states: DataFrame, table: DataFrame, cliques: DataFrame, n_bins: int) -> DataFrame:
    """As pair_ratios, from the stored states alone; moves go by one bin at most.

    Of a branch below ones the sum over those cliques is told by its parent and bin, and likewise of all cliques by the bin; only
    branches that are one themselves are looked at one by one.
    """
    branches = table.where("branch_ix is not null").select("id", "parent")
    ones = states.where("state").select("clique", "id").join(cliques.select("clique", "alpha", "nu"), "clique")
    inner = ones.withColumnRenamed("id", "parent").join(table.where("kind <> 'leaf'").select(F.col("id").alias("parent")), "parent", "left_semi")

    def ln(to: str, bin_: Column) -> Column:
        return P.safe_ln(P.transition("alpha", "nu", bin_, n_bins)[to])

    def rises(rows: DataFrame, by: list[str], f: Callable[[Column], Column], name: str) -> DataFrame:
        """Sums of f(lo + 1) - f(lo) by lo; differences come first, so that the guard values for ln 0 meet."""
        lo = F.col("lo")
        steps = rows.withColumn("lo", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 2))))
        return steps.groupBy(*by, "lo").agg(F.sum(f(lo + 1) - f(lo)).alias(name))

    all_of = rises(cliques.select("alpha", "nu"), [], lambda b: ln("p00", b), "rise")
    below = rises(inner.select("parent", "alpha", "nu"), ["parent"], lambda b: ln("p10", b) - ln("p00", b), "rise_1")
    both = moves.select("pair", F.explode(F.array(F.struct(F.col("id_1").alias("id"), F.col("bin_1").alias("bin"), F.col("move").alias("by")), F.struct(F.col("id_2").alias("id"), F.col("bin_2").alias("bin"), (-F.col("move")).alias("by")))).alias("x")).select("pair", "x.*").join(branches, "id")
    up = inner.select("clique", "parent", F.lit(True).alias("up"))
    met = ones.join(both.where("by <> 0"), "id").join(up, ["clique", "parent"], "left")
    bin_, to = F.col("bin"), F.col("bin") + F.col("by")

    def own(one: str, zero: str) -> Column:
        return (ln(one, to) - ln(one, bin_)) - (ln(zero, to) - ln(zero, bin_))

    seen = met.groupBy("pair", "id").agg(F.sum(F.when(F.col("up"), own("p11", "p10")).otherwise(own("p01", "p00"))).alias("d"))
    lo = F.when(F.col("by") > 0, bin_).when(F.col("by") < 0, bin_ - 1)
    rows = both.withColumn("lo", lo).join(all_of, "lo", "left").join(below, ["parent", "lo"], "left").join(seen, ["pair", "id"], "left")
    d = F.col("by") * (F.coalesce("rise", F.lit(0.0)) + F.coalesce("rise_1", F.lit(0.0))) + F.coalesce("d", F.lit(0.0))
    return rows.groupBy("pair").agg(F.sum(d).alias("log_ratio"))


def moved_bins(branches: DataFrame, moves: DataFrame, ratios: DataFrame, seed: int, iteration: int) -> DataFrame:
    """Branches (id, bin) after the accepted moves."""
    took = moves.join(ratios, "pair").where(P.accepted(F.col("log_ratio"), P.uniform("pair", iteration, seed=seed + 7)))
    both = took.select(F.explode(F.array(F.struct(F.col("id_1").alias("id"), F.col("move").alias("by")), F.struct(F.col("id_2").alias("id"), (-F.col("move")).alias("by")))).alias("x")).select("x.*")
    return branches.join(both, "id", "left").select("id", (F.col("bin") + F.coalesce("by", F.lit(0))).cast("int").alias("bin"))


# -- blocks of named parameters ----------------------------------------------------------------------------------------------------
def named(cliques: DataFrame, tree: str, names: DataFrame) -> DataFrame:
    """(name, value) of a tree's clique parameters; ``names`` has (clique, name) of the other tree's leaves."""
    rows = cliques.join(names, "clique")
    kinds = F.explode(F.array(F.struct(F.lit("alpha").alias("kind"), F.col("alpha").alias("value")), F.struct(F.lit("log_nu").alias("kind"), F.col("log_nu").alias("value"))))
    return rows.select("name", kinds.alias("x")).select(F.concat_ws("_", F.lit(tree), "x.kind", "name").alias("name"), F.col("x.value").alias("value"))


def generated_parameters(spark: SparkSession, tree: str, branch_names: DataFrame, clique_names: DataFrame, n_bins: int, mean: float, var: float, seed: int = 0, fixed: dict[str, float | None] | None = None) -> DataFrame:
    """(name, value) of a scenario: alpha, log_nu per clique, a bin per branch, and the mean and variance of log_nu.

    ``fixed`` has one value for all of ``alpha``, ``log_nu`` or ``branch_lengths``; what isn't in it, or None, is drawn.
    """
    fixed = {k: v for k, v in (fixed or {}).items() if v is not None}
    if not 0 <= fixed.get("branch_lengths", 0) < n_bins or not 0 <= fixed.get("alpha", 0) <= 1:
        raise ValueError(f"bins lie from 0 to {n_bins - 1}, and alpha from 0 to 1")
    if var <= 0 or n_bins < 2:
        raise ValueError("the variance must be above 0, and there must be two bins or more")
    a = clique_names.select(F.concat(F.lit(f"{tree}_alpha_"), "name").alias("name"), (F.lit(float(fixed["alpha"])) if "alpha" in fixed else P.uniform("name", seed=seed)).alias("value"))
    v = clique_names.select(F.concat(F.lit(f"{tree}_log_nu_"), "name").alias("name"), (F.lit(float(fixed["log_nu"])) if "log_nu" in fixed else mean + math.sqrt(var) * P.normal("name", seed=seed + 1)).alias("value"))
    b = branch_names.select(F.concat(F.lit(f"{tree}_branch_lengths_"), "name").alias("name"), (F.lit(float(fixed["branch_lengths"])) if "branch_lengths" in fixed else F.floor(P.uniform("name", seed=seed + 2) * n_bins).cast("double")).alias("value"))
    h = spark.createDataFrame([(f"{tree}_mean_log_nu", float(mean)), (f"{tree}_var_log_nu", float(var))], "name string, value double")
    return a.unionByName(v).unionByName(b).unionByName(h)


def last_by_name(blocks: list[DataFrame]) -> DataFrame:
    """(name, value) of several blocks; of equal names the one of the latest block holds."""
    out = None
    for k, block in enumerate(blocks):
        rows = block.select("name", "value", F.lit(k).alias("k"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("name").agg(F.max_by("value", "k").alias("value"))


def posterior_summary(draws: DataFrame) -> DataFrame:
    """(name, post_mean, post_var, post_sd, n) of draws (name, value, iteration)."""
    v = F.var_samp("value")
    return draws.groupBy("name").agg(F.avg("value").alias("post_mean"), v.alias("post_var"), F.sqrt(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0))).alias("post_sd"), F.count(F.lit(1)).alias("n"))

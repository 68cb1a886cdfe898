"""The two tasks: ``simulate`` and ``infer``. Operators do the work; the loop here only strings them together.

Every iteration writes its tables to the shared folder, so plans stay short and a lost executor costs one iteration at most. All
randomness comes from keys, seed and iteration, so repeated tasks draw the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions.prob import accepted, effort, normal, p_link, uniform
from cladewise.operators import field as fields
from cladewise.operators import likelihood, msms, params, sparse, trees
from cladewise.sources import writers
from cladewise.store import Cuts

Listener = Callable[[str, dict], None]


@dataclass(frozen=True)
class Config:
    """Options with their defaults."""

    iterations: int = 10_000
    simulation_iterations: int = 5_000
    n_burnin: int = 10
    burnin: int = 1_000
    n_bins: int = 20
    epsilon: float = 0.001
    error_rate: float | None = None
    gamma: float = 5.0
    alpha: float = 0.5
    log_nu_mean: float = 0.0
    log_nu_sd: float = 0.1
    update_y: bool = True
    update_z: bool = True
    update_parameters: bool = True
    update_branches: bool = True
    simple_error: bool = False
    log_nu_var: float = 1.0
    contamination: float = 0.001
    trace_every: int = 1
    trace_states: bool = False
    seed: int = 0
    steps: dict = field(default_factory=lambda: {"alpha": 0.1, "log_nu": 0.3, "gamma": 0.5, "epsilon": 0.0005, "mean_log_nu": 0.2, "var_log_nu": 0.2, "filter": 8, "contamination": 0.0005})

    def __post_init__(self) -> None:
        if not 2 <= self.n_bins < 255:
            raise ValueError("the number of bins must be from 2 to 254")
        if not 0 < self.epsilon < 1 or self.gamma <= 0:
            raise ValueError("epsilon lies in (0, 1) and gamma above 0")
        if not 0 < self.contamination < 1 or self.log_nu_var <= 0:
            raise ValueError("contamination lies in (0, 1) and the variance of log_nu above 0")


@dataclass
class Spectra:
    """Mass-spectrum runs as the chain needs them, species and molecules by leaf index; see operators.msms for the columns. Assignments
    start with all features on the unknown molecule, filters with index 128."""

    runs: DataFrame
    candidates: DataFrame
    unknowns: DataFrame
    assigned: DataFrame | None = None
    filters: DataFrame | None = None
    contamination: float = 0.001


@dataclass
class State:
    """The chain's tables and numbers."""

    species: DataFrame
    molecules: DataFrame
    shape: sparse.Shape
    links: DataFrame
    occ_r: DataFrame
    occ_c: DataFrame
    cliques_s: DataFrame
    cliques_m: DataFrame
    z_s: DataFrame
    z_m: DataFrame
    y: DataFrame
    gamma_r: float
    gamma_c: float
    epsilon: float
    #: Mean and variance of log_nu, by tree.
    hyper: dict[str, tuple[float, float]]
    spectra: Spectra | None = None


def log_listener(event: str, what: dict) -> None:
    """Events go to the log of this process; nothing is sent anywhere."""
    import logging

    logging.getLogger("cladewise").info("%s %s", event, what)


def node_table(edges: DataFrame, n_bins: int, seed: int) -> DataFrame:
    """Nodes with bins and their parent's indices."""
    table = trees.nodes(trees.validated(edges))
    bins = trees.bins_from_tree(table, n_bins, seed).select("id", "bin")
    up = table.select(F.col("id").alias("parent"), F.col("node_ix").alias("parent_ix"), F.col("internal_ix").alias("up"))
    return table.join(bins, "id", "left").join(up, "parent", "left")


def build(spark: SparkSession, cuts: Cuts, config: Config, species: DataFrame, molecules: DataFrame, names: DataFrame, papers_r: DataFrame, papers_c: DataFrame) -> State:
    """A model from edge lists (child, parent, length, ord), links (species, molecules) and paper counts (leaf, n, ord)."""
    s, m = (cuts.save(n, node_table(e, config.n_bins, config.seed)) for n, e in (("species", species), ("molecules", molecules)))
    n_r, n_c = (t.where("kind = 'leaf'").count() for t in (s, m))
    links, bad = likelihood.links_of_names(names, s, m)
    wrong = bad.limit(3).collect()
    if wrong:
        raise ValueError("links of names that are no leaves: " + "; ".join(f"{b.species}, {b.molecules}" for b in wrong))
    links = cuts.save("links", links)
    occ_r, occ_c = (cuts.save(n, likelihood.occurrences(t, p)) for n, t, p in (("occ_r", s, papers_r), ("occ_c", m, papers_c)))
    cliques = [cuts.save(n, params.initial_cliques(t.where("kind = 'leaf'").select(F.col("leaf_ix").alias("clique")), config.seed + k, config.log_nu_sd)) for k, (n, t) in enumerate((("cliques_s", m), ("cliques_m", s)))]
    nothing = spark.createDataFrame([], "internal_ix long, other_ix long, state boolean")
    y = cuts.save("y", links.withColumns({"state": F.lit(True), "n_ones": F.lit(0)}))
    return State(s, m, sparse.Shape(n_r, n_c, config.iterations), links, occ_r, occ_c, *cliques, nothing, nothing, y, config.gamma, config.gamma, config.epsilon, dict.fromkeys(("species", "molecules"), (config.log_nu_mean, config.log_nu_var)))


def field_of(state: State, config: Config, use_links: bool) -> fields.Field:
    rows = state.species.where("kind = 'leaf'").select(F.col("leaf_ix").alias("r"), F.col("up").alias("up_r"), F.col("bin").alias("bin_r"))
    rows = rows.join(state.occ_r.select(F.col("leaf_ix").alias("r"), effort(state.gamma_r, "occ").alias("effort_r")), "r").join(state.cliques_m.select(F.col("clique").alias("r"), F.col("alpha").alias("alpha_m"), F.col("nu").alias("nu_m")), "r")
    cols = state.molecules.where("kind = 'leaf'").select(F.col("leaf_ix").alias("c"), F.col("up").alias("up_c"), F.col("bin").alias("bin_c"))
    cols = cols.join(state.occ_c.select(F.col("leaf_ix").alias("c"), effort(state.gamma_c, "occ").alias("effort_c")), "c").join(state.cliques_s.select(F.col("clique").alias("c"), F.col("alpha").alias("alpha_s"), F.col("nu").alias("nu_s")), "c")
    ms = state.spectra
    seen = (lambda cells: msms.cell_log_ratio(cells, ms.runs, ms.assigned, ms.filters, ms.contamination)) if ms and use_links else None
    return fields.Field(state.shape, config.n_bins, rows, cols, state.z_s, state.z_m, state.links, state.epsilon, use_links, seen)


def stored_states(state: State, tree: str) -> DataFrame:
    """(clique, id, node_ix, state) of a tree's stored states."""
    own, other, table, z = ("r", "c", state.species, state.z_s) if tree == "species" else ("c", "r", state.molecules, state.z_m)
    return sparse.clique_states(state.y.where("state"), z, table, own, other).join(table.select("id", "node_ix"), "id")


def update_z(spark: SparkSession, cuts: Cuts, state: State, config: Config, tree: str, step: fields.Step, iteration: int) -> float:
    """New Z of a tree; returns the sum of its cliques' densities."""
    table, cliques = (state.species, state.cliques_s) if tree == "species" else (state.molecules, state.cliques_m)
    arrays = fields.TreeArrays.cached(table, config.n_bins)
    seed = config.seed * 2 + (tree == "molecules")
    new = fields.update_cliques(spark, cliques.select("clique", "alpha", "nu"), stored_states(state, tree).select("clique", "node_ix", "state"), arrays, step, seed, iteration)
    new = cuts.save(f"cliques-{tree}", new)
    z = cuts.save(f"z-{tree}", fields.z_of(new, table))
    if tree == "species":
        state.z_s = z
    else:
        state.z_m = z
    return new.where("node_ix < 0").agg(F.sum("density")).first()[0] or 0.0


def update_tree_parameters(cuts: Cuts, state: State, config: Config, tree: str, iteration: int) -> None:
    """alpha, log_nu and branch bins of a tree, each by Metropolis-Hastings."""
    table, cliques = (state.species, state.cliques_s) if tree == "species" else (state.molecules, state.cliques_m)
    states = cuts.save(f"states-{tree}", stored_states(state, tree).select("clique", "id", "state"))
    seed = config.seed * 31 + (tree == "molecules") * 17
    counts = fields.bulk_counts(table, config.n_bins)
    for name, propose in (("alpha", params.proposed_alpha), ("log_nu", params.proposed_log_nu)):
        tries = propose(cliques, config.steps[name], seed, iteration)
        touched = fields.touched_branches(states, table, cliques)
        done = params.decide_cliques(tries, params.clique_ratios(touched, tries, counts), name, seed, iteration, *state.hyper[tree])
        cliques = cuts.save(f"params-{tree}-{name}", done.drop("accepted"))
    branches = table.where("not is_root").select("id", "bin")
    if config.update_branches:
        table = moved_branches(cuts, table, branches, states, cliques, config, tree, seed, iteration)
    rng = np.random.Generator(np.random.Philox(key=[seed + 5, iteration]))
    state.hyper[tree] = params.updated_hyper(params.log_nu_moments(cliques), *state.hyper[tree], (config.steps["mean_log_nu"], config.steps["var_log_nu"]), rng)
    if tree == "species":
        state.species, state.cliques_s = table, cliques
    else:
        state.molecules, state.cliques_m = table, cliques


def moved_branches(cuts: Cuts, table: DataFrame, branches: DataFrame, states: DataFrame, cliques: DataFrame, config: Config, tree: str, seed: int, iteration: int) -> DataFrame:
    """The node table after a move of each pair of branches."""
    moves = cuts.save(f"moves-{tree}", params.pair_moves(params.branch_pairs(branches, seed, iteration), config.n_bins, seed, iteration))
    ratios = params.sparse_pair_ratios(moves, fields.touched_branches(states, table, cliques), cliques, config.n_bins)
    bins = params.moved_bins(branches, moves, ratios, seed, iteration)
    return cuts.save(f"nodes-{tree}", table.drop("bin").join(bins, "id", "left"))


def start_spectra(cuts: Cuts, spectra: Spectra, config: Config) -> Spectra:
    """Spectra with a start for what isn't given; features without a bin for the unknown molecule are an error."""
    lacking = msms.features_without_bin(spectra.candidates, spectra.unknowns).limit(1).collect()
    if lacking:
        raise ValueError(f"no bin for the unknown molecule in run {lacking[0].run}, feature {lacking[0].feature}")
    assigned = cuts.save("assigned", spectra.assigned if spectra.assigned is not None else msms.all_unknown(spectra.unknowns))
    pairs = spectra.candidates.join(spectra.runs.select("run", "filter"), "run").select("filter", "molecule").distinct()
    filters = spectra.filters if spectra.filters is not None else pairs.withColumn("index", F.lit(params.START["filter_index"]).cast("int"))
    return replace(spectra, assigned=assigned, filters=cuts.save("filters", filters), contamination=config.contamination)


def update_spectra(cuts: Cuts, state: State, config: Config, iteration: int) -> None:
    """Assignments of all runs, filters and contamination, each by Metropolis-Hastings."""
    ms, y = state.spectra, state.y.where("state")
    seed = config.seed * 131 + 17
    new = msms.updated_assignments(ms.candidates, ms.unknowns, ms.assigned, ms.runs, y, ms.filters, ms.contamination, seed, iteration)
    ms.assigned = cuts.save("assigned", new)
    if not config.update_parameters:
        return
    step = F.round(config.steps["filter"] * normal("filter", "molecule", iteration, seed=seed)).cast("int")
    tried = ms.filters.select("filter", "molecule", (F.col("index") + step).alias("new")).where("new between 1 and 254")
    ratios = msms.filter_ratios(y, ms.runs, ms.assigned, ms.filters, tried)
    took = ratios.where(accepted(F.col("log_ratio"), uniform("filter", "molecule", iteration, seed=seed + 1))).join(tried, ["filter", "molecule"]).select("filter", "molecule", "new")
    ms.filters = cuts.save("filters", ms.filters.join(took, ["filter", "molecule"], "left").select("filter", "molecule", F.coalesce("new", "index").alias("index")))
    rng = np.random.Generator(np.random.Philox(key=[seed, iteration]))
    old, u = ms.contamination, rng.random()
    try_ = abs(old + config.steps["contamination"] * rng.standard_normal())
    if 0 < try_ < 1:
        ratio = msms.contamination_ratio(y, ms.runs, ms.assigned, state.shape.n_cols, old, try_).first().log_ratio or 0.0
        if math.log(u) < ratio + params.ln_prior_of("contamination", try_) - params.ln_prior_of("contamination", old):
            ms.contamination = try_


def parameter_rows(state: State, tree: str, iteration: int) -> DataFrame:
    """(iteration, name, value) of a tree's cliques and branches: <tree>_alpha_<leaf>, <tree>_log_nu_<leaf> by the other tree's leaves,
    <tree>_branch_lengths_<node> as bins."""
    own, other, cliques = (state.species, state.molecules, state.cliques_s) if tree == "species" else (state.molecules, state.species, state.cliques_m)
    names = other.where("kind = 'leaf'").select(F.col("leaf_ix").alias("clique"), F.col("id").alias("name"))
    bins = own.where("not is_root").select(F.concat(F.lit(f"{tree}_branch_lengths_"), "id").alias("name"), F.col("bin").cast("double").alias("value"))
    return params.named(cliques, tree, names).unionByName(bins).select(F.lit(iteration).alias("iteration"), "name", "value")


def set_parameters(cuts: Cuts, state: State, tree: str, values: DataFrame) -> None:
    """Give a tree's cliques and branches the values that are named, see parameter_rows; others stay."""
    own, other, cliques = (state.species, state.molecules, state.cliques_s) if tree == "species" else (state.molecules, state.species, state.cliques_m)

    def of(kind: str, key: str) -> DataFrame:
        prefix = f"{tree}_{kind}_"
        return values.where(F.col("name").startswith(prefix)).select(F.substring("name", len(prefix) + 1, 2**31 - 1).alias(key), F.col("value").alias(f"new_{kind}"))

    names = other.where("kind = 'leaf'").select(F.col("leaf_ix").alias("clique"), F.col("id").alias("name"))
    rows = cliques.join(names, "clique").join(of("alpha", "name"), "name", "left").join(of("log_nu", "name"), "name", "left")
    log_nu = F.coalesce("new_log_nu", "log_nu")
    cliques = cuts.save(f"set-{tree}", rows.select("clique", F.coalesce("new_alpha", "alpha").alias("alpha"), log_nu.alias("log_nu"), F.exp(log_nu).alias("nu")))
    table = cuts.save(f"bins-{tree}", own.join(of("branch_lengths", "id"), "id", "left").withColumn("bin", F.coalesce(F.col("new_branch_lengths").cast("int"), "bin")).drop("new_branch_lengths"))
    if tree == "species":
        state.species, state.cliques_s = table, cliques
    else:
        state.molecules, state.cliques_m = table, cliques


def z_shape(state: State, tree: str) -> sparse.Shape:
    """Rows and columns of a tree's Z: its internal nodes stand for its leaves."""
    if tree == "species":
        return sparse.Shape(state.species.where("internal_ix is not null").count(), state.shape.n_cols)
    return sparse.Shape(state.shape.n_rows, state.molecules.where("internal_ix is not null").count())


def z_cells(z: DataFrame, tree: str) -> DataFrame:
    """Z (internal_ix, other_ix, state) as a matrix (r, c, state)."""
    r, c = ("internal_ix", "other_ix") if tree == "species" else ("other_ix", "internal_ix")
    return z.select(F.col(r).alias("r"), F.col(c).alias("c"), "state")


def z_from_positions(state: State, tree: str, positions: DataFrame) -> DataFrame:
    """(internal_ix, other_ix, state) of given positions of ones; positions outside of the matrix are an error."""
    shape = z_shape(state, tree)
    r, c = sparse.row_col(shape, "position")
    cells = sparse.within(positions.select(r.alias("r"), c.alias("c")), shape).distinct()
    inner, other = ("r", "c") if tree == "species" else ("c", "r")
    return cells.select(F.col(inner).alias("internal_ix"), F.col(other).alias("other_ix"), F.lit(True).alias("state"))


def start_states(cuts: Cuts, state: State, start_y: DataFrame | None, start_z: dict[str, DataFrame]) -> None:
    """Set Y and Z from given positions of ones, as readers.y_state and readers.z_state give them."""
    if start_y is not None:
        r, c = sparse.row_col(state.shape, "position")
        cells = sparse.within(start_y.select(r.alias("r"), c.alias("c")), state.shape).distinct()
        state.y = cuts.save("y", cells.withColumns({"state": F.lit(True), "n_ones": F.lit(0)}))
    if "species" in start_z:
        state.z_s = cuts.save("z-species", z_from_positions(state, "species", start_z["species"]))
    if "molecules" in start_z:
        state.z_m = cuts.save("z-molecules", z_from_positions(state, "molecules", start_z["molecules"]))


def update_observation(state: State, config: Config, iteration: int) -> None:
    """gamma of both trees and epsilon, each by the full likelihood ratio."""
    rng = np.random.Generator(np.random.Philox(key=[config.seed, iteration]))
    y = state.y.where("state")
    for name in ("gamma_r", "gamma_c", "epsilon"):
        prior = name.split("_")[0]
        old, now = getattr(state, name), (state.gamma_r, state.gamma_c, state.epsilon)
        new = abs(old + config.steps[prior] * rng.standard_normal())
        u = rng.random()
        if new <= 0 or (name == "epsilon" and new >= 1):
            continue
        tried = tuple(new if k == name else v for k, v in zip(("gamma_r", "gamma_c", "epsilon"), now, strict=True))
        ratio = likelihood.log_likelihood_ratio(y, state.links, state.occ_r, state.occ_c, state.shape, now, tried).first().log_ratio
        if math.log(u) < ratio + params.ln_prior_of(prior, new) - params.ln_prior_of(prior, old):
            setattr(state, name, new)


def infer(
    spark: SparkSession, config: Config, species: DataFrame, molecules: DataFrame, names: DataFrame, papers_r: DataFrame, papers_c: DataFrame, listener: Listener = log_listener,
    start_y: DataFrame | None = None, start_z: dict[str, DataFrame] | None = None, spectra: Spectra | None = None,
) -> dict[str, DataFrame]:
    """The posterior of the field and the parameters.

    Returns ``y`` (r, c, n_ones, fraction) with the share of counted draws, ``trace`` (iteration, name, value) of all parameters, cliques
    and branches included, and ``summary`` of it; with spectra ``assigned`` and ``filters`` at the end; with ``trace_states`` the ones of
    each traced draw, ``y_trace`` and ``z_<tree>_trace`` (iteration, position). The denominator is the number of draws that were counted.
    ``start_y`` and ``start_z`` (by tree) hold positions of ones to start from; a tree whose Z is given isn't initialised from its leaves.
    """
    if not config.update_y and start_y is None and names.limit(1).count() == 0:
        raise ValueError("an empty field can't be held fixed")
    cuts = Cuts(spark, "infer")
    state = build(spark, cuts, config, species, molecules, names, papers_r, papers_c)
    start_states(cuts, state, start_y, start_z or {})
    state.spectra = start_spectra(cuts, spectra, config) if spectra else None
    listener("start", {"iterations": config.iterations, "burnin_rounds": config.n_burnin, "burnin": config.burnin})
    for tree in ("species", "molecules"):
        if tree not in (start_z or {}):
            update_z(spark, cuts, state, config, tree, fields.likeliest_clique, 0)
    rows: list[tuple[int, str, float]] = []
    traces = {name: f"{cuts.root}/{name}" for name in ("parameters", "y_trace", "z_species_trace", "z_molecules_trace")}
    shapes = {tree: z_shape(state, tree) for tree in ("species", "molecules")}
    counts = cuts.save("counts", state.y.where("false").select("r", "c", F.lit(0).alias("n")))
    total, draws = config.n_burnin * config.burnin + config.iterations, 0
    for it in range(1, total + 1):
        burning = it <= config.n_burnin * config.burnin
        if config.update_y:
            new = fields.sparsely_swept_y(spark, field_of(state, config, True), state.y, config.seed, it)
            # zeros that are stored leave once a burn-in round
            state.y = cuts.save("y", sparse.without_zeros(new) if burning and it % config.burnin == 0 else new)
        density = 0.0
        for tree in ("species", "molecules"):
            if config.update_z:
                density += update_z(spark, cuts, state, config, tree, fields.gibbs_clique, it)
            if config.update_parameters:
                update_tree_parameters(cuts, state, config, tree, it)
        if config.update_parameters and not config.simple_error:
            update_observation(state, config, it)
        if state.spectra:
            update_spectra(cuts, state, config, it)
        if burning:
            if it % config.burnin == 0:
                listener("burnin", {"round": it // config.burnin})
            continue
        if it % state.shape.thinning == 0:
            ones = state.y.where("state").select("r", "c", F.lit(1).alias("n"))
            counts = cuts.save("counts", counts.unionByName(ones).groupBy("r", "c").agg(F.sum("n").alias("n")))
            draws += 1
        if it % config.trace_every == 0:
            rows += [(it, "gamma_species", state.gamma_r), (it, "gamma_molecules", state.gamma_c), (it, "epsilon", state.epsilon), (it, "pseudo_log_density", density)]
            rows += [(it, f"{tree}_{kind}", x) for tree, both in state.hyper.items() for kind, x in zip(("mean_log_nu", "var_log_nu"), both, strict=True)]
            if state.spectra:
                rows.append((it, "contamination", state.spectra.contamination))
            writers.append_trace(parameter_rows(state, "species", it).unionByName(parameter_rows(state, "molecules", it)), traces["parameters"])
            if config.trace_states:
                writers.append_trace(writers.trace_rows(state.y, state.shape, it), traces["y_trace"])
                for tree, z in (("species", state.z_s), ("molecules", state.z_m)):
                    writers.append_trace(writers.trace_rows(z_cells(z, tree), shapes[tree], it), traces[f"z_{tree}_trace"])
    listener("end", {"draws": draws})
    trace = spark.createDataFrame(rows, "iteration int, name string, value double")
    if rows:
        trace = trace.unionByName(spark.read.schema(trace.schema).parquet(traces["parameters"]))
    y = counts.select("r", "c", F.col("n").alias("n_ones"), (F.col("n") / float(max(1, draws))).alias("fraction"))
    out = {"y": y, "trace": trace, "summary": params.posterior_summary(trace)}
    if state.spectra:
        out |= {"assigned": state.spectra.assigned, "filters": state.spectra.filters}
    if config.trace_states and rows:
        out |= {name: spark.read.schema("iteration int, position long").parquet(path) for name, path in traces.items() if name != "parameters"}
    return out


def simulate(spark: SparkSession, config: Config, species: DataFrame, molecules: DataFrame, papers_r: DataFrame, papers_c: DataFrame, iterations: int | None = None, values: DataFrame | None = None) -> dict[str, DataFrame]:
    """A field from the prior and links from it: ``y`` (r, c, state), ``z_s``, ``z_m``, ``links`` (r, c), ``parameters`` (name, value).

    Parameters come from the prior; those named in ``values`` (name, value) have that value.
    """
    cuts = Cuts(spark, "simulate")
    none = spark.createDataFrame([], "species string, molecules string")
    state = build(spark, cuts, config, species, molecules, none, papers_r, papers_c)
    leaves = [t.where("kind = 'leaf'").select(F.col("leaf_ix").alias("clique")) for t in (state.molecules, state.species)]
    state.cliques_s, state.cliques_m = (cuts.save(f"prior-{k}", params.simulated_cliques(x, config.log_nu_mean, config.log_nu_var, config.seed + k)) for k, x in enumerate(leaves))
    if values is not None:
        for tree in ("species", "molecules"):
            set_parameters(cuts, state, tree, values)
    for tree in ("species", "molecules"):
        update_z(spark, cuts, state, config, tree, fields.simulated_clique, 0)
    for it in range((iterations if iterations is not None else config.simulation_iterations) + 1):
        state.y = cuts.save("y", fields.sparsely_swept_y(spark, field_of(state, config, False), state.y, config.seed + 1, it).where("state"))
        for tree in ("species", "molecules"):
            update_z(spark, cuts, state, config, tree, fields.gibbs_clique, it + 1)
    truth = parameter_rows(state, "species", 0).unionByName(parameter_rows(state, "molecules", 0)).select("name", "value")
    return {"y": state.y.select("r", "c", "state"), "z_s": state.z_s, "z_m": state.z_m, "links": simulated_links(spark, state, config), "parameters": truth}


def simulated_links(spark: SparkSession, state: State, config: Config) -> DataFrame:
    """(r, c) of links drawn for every cell by P(link | state): cells of ones by their efforts, the others all alike."""
    eps = config.error_rate if config.error_rate is not None else config.epsilon
    f = field_of(replace(state), config, False)
    ones = state.y.where("state").select("r", "c")
    cells = ones.join(f.rows.select("r", "effort_r"), "r").join(f.cols.select("c", "effort_c"), "c")
    p = p_link(F.lit(True), F.lit(True), F.col("effort_r") * F.col("effort_c"), eps, config.simple_error)
    found = cells.where(uniform("r", "c", seed=config.seed + 99) < p).select("r", "c")
    return found.unionByName(fields.bernoulli_cells(spark, state.shape, eps, config.seed + 99).join(ones, ["r", "c"], "left_anti"))

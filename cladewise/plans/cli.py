"""Command line: make a scenario, simulate from it, infer from links, assign features, compare parameters.

    python -m cladewise.plans.cli scenario --species-type balanced --species-nodes 63 --molecules-type star --molecules-nodes 40 --out s1
    python -m cladewise.plans.cli simulate --tree-species s1/species --tree-molecules s1/molecules --parameters s1/parameters --out s1/simulated
    python -m cladewise.plans.cli infer --tree-species s1/species --tree-molecules s1/molecules --links s1/simulated/links --out s1/inferred
    python -m cladewise.plans.cli assign --edges edges.tsv --min-score 0.3 --out assigned
    python -m cladewise.plans.cli compare --parameters s1/parameters --summary s1/inferred/summary --out s1/compared

Tables are folders or files of delimited text with a header. Every command returns 0, or 2 with a message about what is wrong.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators import analysis, matching, params, sparse, trees
from cladewise.plans import engine
from cladewise.session import ship
from cladewise.sources import readers, synthetic, writers

TREE_NAMES = ("species", "molecules")
_SCRIPTS = {
    "simulate": 'cd "$(dirname "$0")" && exec python -m cladewise.plans.cli simulate --tree-species species --tree-molecules molecules --papers-species species_papers --papers-molecules molecules_papers --parameters parameters --iterations 2000 --seed {seed} --out simulated "$@"\n',
    "infer": 'cd "$(dirname "$0")" && exec python -m cladewise.plans.cli infer --tree-species species --tree-molecules molecules --papers-species species_papers --papers-molecules molecules_papers --links simulated/links --iterations 3000 --fix-branches --out inferred "$@"\n',
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladewise", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    tasks = top.add_subparsers(dest="task", required=True)
    made = tasks.add_parser("scenario", help="trees, paper counts, parameters and run scripts")
    for t in TREE_NAMES:
        made.add_argument(f"--{t}-type", choices=sorted(synthetic.TREES), required=True)
        made.add_argument(f"--{t}-nodes", type=int, required=True)
        made.add_argument(f"--{t}-name", default=t)
        made.add_argument(f"--{t}-bin", type=int, help="the bin of all branches, else random ones")
        for kind in ("alpha", "log-nu"):
            made.add_argument(f"--{t}-{kind}", type=float, help="one value for all cliques, else random ones")
        made.add_argument(f"--{t}-mean-log-nu", type=float, default=0.0)
        made.add_argument(f"--{t}-var-log-nu", type=float, default=1.0)
    both = argparse.ArgumentParser(add_help=False)
    for t in TREE_NAMES:
        both.add_argument(f"--tree-{t}", required=True)
        both.add_argument(f"--papers-{t}")
    for name, default in (("iterations", 10_000), ("n-burnin", 10), ("burnin", 1_000)):
        both.add_argument(f"--{name}", type=int, default=default)
    for name in ("epsilon", "gamma", "error-rate"):
        both.add_argument(f"--{name}", type=float)
    sim = tasks.add_parser("simulate", parents=[both], help="a field and links from the prior or from given parameters")
    sim.add_argument("--parameters")
    inf = tasks.add_parser("infer", parents=[both], help="the posterior of field and parameters")
    inf.add_argument("--links", required=True)
    inf.add_argument("--set-y")
    for t in TREE_NAMES:
        inf.add_argument(f"--set-{t}-z")
    for flag in ("fix-y", "fix-z", "fix-branches", "fix-parameters", "simple-error", "write-traces", "write-full"):
        inf.add_argument(f"--{flag}", action="store_true")
    matched = tasks.add_parser("assign", help="features to molecules by the largest total score")
    matched.add_argument("--edges", required=True)
    matched.add_argument("--min-score", type=float, default=0.0)
    compared = tasks.add_parser("compare", help="true parameters beside inferred ones")
    compared.add_argument("--parameters", required=True)
    compared.add_argument("--summary", required=True)
    for p in (made, sim, inf, matched, compared):
        p.add_argument("--out", required=p is not made)
        p.add_argument("--bins", type=int, default=20)
        p.add_argument("--seed", type=int, default=0)
    return top


def scenario(spark: SparkSession, a: argparse.Namespace) -> None:
    out = a.out or "_".join(f"{t[0]}_{getattr(a, f'{t}_type')}_{getattr(a, f'{t}_nodes')}" for t in TREE_NAMES)
    edges = {t: synthetic.TREES[getattr(a, f"{t}_type")](spark, getattr(a, f"{t}_name"), getattr(a, f"{t}_nodes")) for t in TREE_NAMES}
    leaves = {t: trees.leaf_ids(edges[t]) for t in TREE_NAMES}
    values = []
    for k, (t, other) in enumerate(zip(TREE_NAMES, reversed(TREE_NAMES), strict=True)):
        branches = edges[t].select(F.col("child").alias("name"))
        cliques = leaves[other].select(F.col("id").alias("name"))
        fixed = {"alpha": getattr(a, f"{t}_alpha"), "log_nu": getattr(a, f"{t}_log_nu"), "branch_lengths": getattr(a, f"{t}_bin")}
        values.append(params.generated_parameters(spark, t, branches, cliques, a.bins, getattr(a, f"{t}_mean_log_nu"), getattr(a, f"{t}_var_log_nu"), a.seed + k, fixed))
    papers = {t: synthetic.poisson_counts(leaves[t], seed=a.seed + 7) for t in TREE_NAMES}
    writers.write_scenario(out, edges, papers, params.last_by_name(values))
    for name, text in _SCRIPTS.items():
        writers.write_text(spark, f"{out}/{name}.sh", "#!/bin/sh\n" + text.format(seed=a.seed))


def _inputs(spark: SparkSession, a: argparse.Namespace) -> list[DataFrame]:
    none = spark.createDataFrame([], "leaf string, n long, ord long")
    given = [getattr(a, f"papers_{t}") for t in TREE_NAMES]
    return [readers.edges(spark, getattr(a, f"tree_{t}")) for t in TREE_NAMES], [readers.paper_counts(spark, p) if p else none for p in given]


def _config(a: argparse.Namespace, **more) -> engine.Config:
    given = {k: getattr(a, k) for k in ("epsilon", "gamma", "error_rate") if getattr(a, k) is not None}
    return engine.Config(iterations=a.iterations, n_burnin=a.n_burnin, burnin=a.burnin, n_bins=a.bins, seed=a.seed, **given, **more)


def simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    (species, molecules), papers = _inputs(spark, a)
    values = readers.parameters(spark, a.parameters) if a.parameters else None
    made = engine.simulate(spark, _config(a), species, molecules, *papers, a.iterations, values)
    sides = [trees.nodes(e).where("kind = 'leaf'").select(F.col("leaf_ix").alias("ix"), "id") for e in (species, molecules)]
    writers.write_table(writers.link_dump(made["links"], *sides), f"{a.out}/links")
    writers.write_table(made["parameters"], f"{a.out}/parameters", ",")
    shape = sparse.Shape(*(s.count() for s in sides))
    writers.write_table(writers.y_dump(spark, made["y"].withColumn("n_ones", F.lit(0)), shape, *sides, 0, False), f"{a.out}/y")


def infer(spark: SparkSession, a: argparse.Namespace) -> None:
    (species, molecules), papers = _inputs(spark, a)
    links = readers.links(spark, a.links, list(TREE_NAMES))
    starts = {t: readers.z_state(spark, getattr(a, f"set_{t}_z")) for t in TREE_NAMES if getattr(a, f"set_{t}_z")}
    start_y = readers.y_state(spark, a.set_y) if a.set_y else None
    flags = {"update_y": not a.fix_y, "update_z": not a.fix_z, "update_parameters": not a.fix_parameters, "update_branches": not a.fix_branches}
    config = _config(a, simple_error=a.simple_error, trace_states=a.write_traces, **flags)
    got = engine.infer(spark, config, species, molecules, links, *papers, start_y=start_y, start_z=starts)
    sides = [trees.nodes(e).where("kind = 'leaf'").select(F.col("leaf_ix").alias("ix"), "id") for e in (species, molecules)]
    shape = sparse.Shape(*(s.count() for s in sides))
    y = got["y"].select("r", "c", (F.col("fraction") > 0.5).alias("state"), "n_ones")
    draws = max(1, config.iterations // sparse.Shape(1, 1, config.iterations).thinning)
    writers.write_table(writers.y_dump(spark, y, shape, *sides, draws, a.write_full), f"{a.out}/y")
    for name in sorted(set(got) - {"y"}):
        writers.write_table(got[name], f"{a.out}/{name}", ",")


def assign(spark: SparkSession, a: argparse.Namespace) -> None:
    edges = matching.best_edges(matching.read_edges(readers.table(spark, a.edges).drop("_row")))
    writers.write_table(matching.assign(edges, a.min_score), f"{a.out}/assignments", ",")
    writers.write_table(edges, f"{a.out}/edges", ",")


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    found = readers.delimited(spark, a.summary, {"name": "string", "post_mean": "double", "post_var": "double"}, ",")
    writers.write_table(analysis.true_against_inferred(readers.parameters(spark, a.parameters), found), a.out, ",")


TASKS = {"scenario": scenario, "simulate": simulate, "infer": infer, "assign": assign, "compare": compare}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("cladewise").getOrCreate()
    ship(session)
    try:
        TASKS[a.task](session, a)
    except ValueError as wrong:
        print(f"cladewise {a.task}: {wrong}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

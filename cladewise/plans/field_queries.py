"""Registered queries of probabilities, joins, likelihoods, sweeps, spectra and reports; see model_queries for the conventions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions import prob as P
from cladewise.operators import analysis, field, likelihood, matching, msms, params, sparse, trees
from cladewise.plans.base import EPSILON, GAMMA, N_BINS, base, nodes_sql, shape_of, with_base
from cladewise.plans.model_queries import _N, _STATES, _TOTAL, _u, fixed_bins, l_of, r, raw, states, tree, y_of, z_sp
from cladewise.plans.model_queries import Query, D
from cladewise.store import Cuts

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_LOW = "-1.7976931348623157e308"


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def ln(p: str) -> str:
    return f"CASE WHEN ({p}) > 0 THEN ln({p}) ELSE {_LOW} END"


def e_of(nu: str, bin_: str) -> str:
    return f"(CASE WHEN {nu} > 25 THEN 0 ELSE exp(-{nu} * {D} * ({bin_} + 0.5::DOUBLE)) END)"


def p_of(a: str, nu: str, bin_: str, up: str, to: str) -> str:
    """P(to | up) as SQL; up and to are boolean expressions."""
    e = e_of(nu, bin_)
    return f"(CASE WHEN {up} AND {to} THEN {a} + (1 - {a}) * {e} WHEN {up} THEN (1 - {a}) * (1 - {e}) WHEN {to} THEN {a} * (1 - {e}) ELSE 1 - {a} + {a} * {e} END)"


# ---- probabilities ---------------------------------------------------------------------------------------------------------------------
_AN = "((p_partkey % 9) + 1) / 10.0::DOUBLE"
_NU = "((p_partkey % 60) + 0.5::DOUBLE) / 2"


@query("sv_p01_p03_transition", f"""SELECT p_partkey AS k, b, round(1 - a + a * e, 9) AS p00, round(a * (1 - e), 9) AS p01, round((1 - a) * (1 - e), 9) AS p10, round(a + (1 - a) * e, 9) AS p11
FROM (SELECT p_partkey, CAST(b AS INT) AS b, {_AN} AS a, {e_of(_NU, 'b')} AS e FROM part, range({N_BINS}) t(b))""")
def _transition(spark: SparkSession, where: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = raw(spark, where, "part").select(k.alias("k"), ((k % 9 + 1) / 10.0).alias("a"), ((k % 60 + 0.5) / 2).alias("nu"), F.explode(F.sequence(F.lit(0), F.lit(N_BINS - 1))).alias("b"))
    p = P.transition("a", "nu", "b", N_BINS)
    return rows.select("k", "b", *(r(x, 9, name) for name, x in p.items()))


@query("sv_p04_p07_steps", f"""SELECT k, b, up, s, round({p_of('a', 'nu', 'b', 'up', 's')}, 9) AS p, round({p_of('a', 'nu', 'b', 'up', 'false')}, 9) AS to0, round({p_of('a', 'nu', 'b', 'up', 'true')}, 9) AS to1,
round(CASE WHEN s THEN a ELSE 1 - a END, 9) AS stationary
FROM (SELECT p_partkey AS k, p_size % {N_BINS} AS b, {_AN} AS a, {_NU} AS nu, p_partkey % 2 = 1 AS up, p_partkey % 3 = 1 AS s FROM part)""")
def _steps(spark: SparkSession, where: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = raw(spark, where, "part").select(k.alias("k"), (F.col("p_size") % N_BINS).alias("b"), ((k % 9 + 1) / 10.0).alias("a"), ((k % 60 + 0.5) / 2).alias("nu"), (k % 2 == 1).alias("up"), (k % 3 == 1).alias("s"))
    p = P.transition("a", "nu", "b", N_BINS)
    to0, to1 = P.given_parent("up", p)
    return rows.select("k", "b", "up", "s", r(P.transition_to("up", "s", p), 9, "p"), r(to0, 9, "to0"), r(to1, 9, "to1"), r(P.stationary("s", "a"), 9, "stationary"))


_OCC = f"""er AS (SELECT c_custkey AS r, 1 - exp(-{GAMMA}::DOUBLE * ln(coalesce(n, 0) + 1)) AS er FROM customer LEFT JOIN papers_r ON leaf = 'c' || c_custkey),
ec AS (SELECT p_partkey AS c, 1 - exp(-{GAMMA}::DOUBLE * ln(coalesce(n, 0) + 1)) AS ec FROM part LEFT JOIN papers_c ON leaf = 'p' || p_partkey),
lp AS (SELECT k.r, k.c, k.y = 1 AS x, k.l = 1 AS link, CASE WHEN y = 1 AND l = 1 THEN er * ec WHEN y = 1 THEN 1 - er * ec WHEN l = 1 THEN {EPSILON}::DOUBLE ELSE 1 - {EPSILON}::DOUBLE END AS p
       FROM cells k JOIN er ON er.r = k.r JOIN ec ON ec.c = k.c)"""
_SRC = ("cells", "papers_r", "papers_c")


def occ(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    leaf = [raw(spark, where, t).select(F.expr(f"'{x}' || {k}").alias("id"), F.col(k).alias("leaf_ix"), F.lit("leaf").alias("kind")) for t, x, k in (("customer", "c", "c_custkey"), ("part", "p", "p_partkey"))]
    return tuple(likelihood.occurrences(t, base(spark, where, p)) for t, p in zip(leaf, ("papers_r", "papers_c"), strict=True))


def efforts(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    return tuple(likelihood.effort_table(o, GAMMA, n) for o, n in zip(occ(spark, where), ("effort_r", "effort_c"), strict=True))


@query("sv_j01_p08_p10_cells", with_base(f"WITH {_OCC} SELECT r, c, x, link, round(p, 9) AS p FROM lp", *_SRC))
def _cell_p(spark: SparkSession, where: str) -> DataFrame:
    rows = likelihood.cell_probabilities(likelihood.visited(y_of(spark, where), l_of(spark, where)), *efforts(spark, where), EPSILON)
    return rows.withColumn("p", F.round("p", 9))


@query("sv_a01_a03_link_log_likelihood", with_base(f"WITH {_OCC} SELECT count(*) AS n_visited, round(sum({ln('p')}) + ({_TOTAL} - count(*)) * ln(1 - {EPSILON}::DOUBLE), 4) AS log_likelihood FROM lp WHERE p > 0", *_SRC))
def a01(spark: SparkSession, where: str) -> DataFrame:
    """Cells of leaves without papers have probability 0 and would give the guard value; they are left to the cell query."""
    shape, y, links = shape_of(spark, where), y_of(spark, where), l_of(spark, where)
    zero = [o.where("occ = 0").select(F.col("leaf_ix").alias(k)) for o, k in zip(occ(spark, where), "rc", strict=True)]
    bad = y.where("state").join(links, ["r", "c"], "left_semi").select("r", "c")
    bad = bad.join(zero[0], "r", "left_semi").unionByName(bad.join(zero[1], "c", "left_semi")).distinct()
    keep = [m.join(bad, ["r", "c"], "left_anti") for m in (y, links)]
    return likelihood.link_log_likelihood(*keep, *efforts(spark, where), shape, EPSILON).withColumn("log_likelihood", F.round("log_likelihood", 4))


@query("sv_p10_simple_log_likelihood", with_base(f"SELECT count(*) AS n_visited, round(sum(CASE WHEN y = l THEN ln(1 - {EPSILON}::DOUBLE) ELSE ln({EPSILON}::DOUBLE) END) + ({_TOTAL} - count(*)) * ln(1 - {EPSILON}::DOUBLE), 4) AS log_likelihood FROM cells", "cells"))
def _simple(spark: SparkSession, where: str) -> DataFrame:
    ll = likelihood.link_log_likelihood(y_of(spark, where), l_of(spark, where), *efforts(spark, where), shape_of(spark, where), EPSILON, simple=True)
    return ll.withColumn("log_likelihood", F.round("log_likelihood", 4))


@query("sv_g13_g14_log_ratio", with_base(f"""WITH t AS (SELECT k.r, k.c, y, l, ln(coalesce(pr.n, 0) + 1) AS a, ln(coalesce(pc.n, 0) + 1) AS b FROM cells k LEFT JOIN papers_r pr ON pr.leaf = 'c' || k.r LEFT JOIN papers_c pc ON pc.leaf = 'p' || k.c),
f AS (SELECT *, (1 - exp(-5.0::DOUBLE * a)) * (1 - exp(-5.0::DOUBLE * b)) AS e0, (1 - exp(-4.0::DOUBLE * a)) * (1 - exp(-6.0::DOUBLE * b)) AS e1 FROM t)
SELECT round(sum(CASE WHEN y = 1 AND l = 1 THEN CASE WHEN e0 > 0 THEN ln(e1) - ln(e0) ELSE 0 END WHEN y = 1 THEN ln(1 - e1) - ln(1 - e0) WHEN l = 1 THEN ln(0.002::DOUBLE) - ln(0.001::DOUBLE) ELSE ln(0.998::DOUBLE) - ln(0.999::DOUBLE) END)
 + ({_TOTAL} - count(*)) * (ln(0.998::DOUBLE) - ln(0.999::DOUBLE)), 4) AS log_ratio FROM f""", *_SRC))
def _ratio(spark: SparkSession, where: str) -> DataFrame:
    got = likelihood.log_likelihood_ratio(y_of(spark, where), l_of(spark, where), *occ(spark, where), shape_of(spark, where), (5.0, 5.0, 0.001), (4.0, 6.0, 0.002))
    return got.withColumn("log_ratio", F.round("log_ratio", 4))


@query("sv_p11_detection", """SELECT c_custkey AS k, round(CASE WHEN k % 2 = 1 AND k % 3 = 1 THEN f WHEN k % 2 = 1 THEN 1 - f WHEN k % 3 = 1 THEN 0.01 ELSE 0.99 END, 9) AS p
FROM (SELECT c_custkey, c_custkey AS k, (c_custkey % 256) / 255.0::DOUBLE AS f FROM customer)""")
def _detection(spark: SparkSession, where: str) -> DataFrame:
    k = F.col("c_custkey")
    return raw(spark, where, "customer").select(k.alias("k"), r(P.p_detection(k % 2 == 1, k % 3 == 1, P.linear_proba(k % 256), F.lit(0.01)), 9, "p"))


@query("sv_p12_p15_binned", f"""SELECT i, round(i / 255.0::DOUBLE, 12) AS linear, round({ln('i / 255.0::DOUBLE')}, 9) AS log_linear, round({ln('1 - i / 255.0::DOUBLE')}, 9) AS log_reversed, round(1 - pow(1.1::DOUBLE, -i / 10.0::DOUBLE), 9) AS phred,
CASE WHEN i % 50 = 0 THEN NULL ELSE i * 1009 END AS molecule, i AS bin FROM range(256) t(i)""")
def _tables(spark: SparkSession, where: str) -> DataFrame:
    rows = spark.range(256).withColumn("packed", P.pack(F.when(F.col("id") % 50 != 0, F.col("id") * 1009), "id"))
    molecule, bin_ = P.unpack("packed")
    i = F.col("id")
    return rows.select(i.alias("i"), r(P.linear_proba(i), 12, "linear"), r(P.log_linear_proba(i), 9, "log_linear"), r(P.log_linear_proba_reversed(i), 9, "log_reversed"), r(P.phred_proba(i), 9, "phred"), molecule.alias("molecule"), bin_.cast("long").alias("bin"))


_PNAME = "CASE c_custkey % 10 WHEN 0 THEN 'gamma_species' WHEN 1 THEN 'epsilon' WHEN 2 THEN 'species_alpha_p' || c_custkey WHEN 3 THEN 'molecules_log_nu_c' || c_custkey WHEN 4 THEN 'species_mean_log_nu' WHEN 5 THEN 'molecules_var_log_nu' WHEN 6 THEN 'species_branch_lengths_c' || c_custkey WHEN 7 THEN 'gamma_molecules' WHEN 8 THEN 'tree:path/to.file:x.tsv' ELSE 'lotus.v1.tsv' END"


@query("sv_p17_p18_names", f"""SELECT k, name, CASE WHEN name LIKE 'gamma%' THEN 'gamma' WHEN name = 'epsilon' THEN 'epsilon' WHEN contains(name, '_alpha_') THEN 'alpha' WHEN contains(name, '_mean_log_nu') THEN 'mean_log_nu' WHEN contains(name, '_var_log_nu') THEN 'var_log_nu'
WHEN contains(name, '_log_nu_') THEN 'log_nu' WHEN contains(name, '_branch_lengths_') THEN 'branch_lengths' ELSE 'other' END AS kind,
CASE WHEN name LIKE 'species%' OR name = 'gamma_species' THEN 'species' WHEN name LIKE 'molecules%' OR name = 'gamma_molecules' THEN 'molecules' ELSE 'other' END AS dim,
regexp_extract(name, '^(.*)\\.', 1) AS prefix, split_part(name, ':', 1) AS tree_name, CASE WHEN contains(name, ':') THEN substr(name, instr(name, ':') + 1) END AS path FROM (SELECT c_custkey AS k, {_PNAME} AS name FROM customer)""")
def _names(spark: SparkSession, where: str) -> DataFrame:
    rows = raw(spark, where, "customer").select(F.col("c_custkey").alias("k"), F.expr(_PNAME).alias("name"))
    first, path = P.name_and_path("name")
    parts = F.split("name", ":", 2)
    return rows.select("k", "name", P.parameter_class("name").alias("kind"), P.parameter_dimension("name").alias("dim"), P.before_last_dot("name").alias("prefix"), first.alias("tree_name"), F.when(F.size(parts) > 1, path).alias("path"))


@query("sv_priors", """SELECT p_partkey AS k, round(2 * ln(4.6::DOUBLE) + ln(x) - 4.6::DOUBLE * x, 6) AS gamma_, round(ln(r) - x * r, 6) AS exponential, round(-0.5::DOUBLE * ln(2 * pi() * 2) - x * x / 4, 6) AS normal
FROM (SELECT p_partkey, (p_partkey % 97 + 1) / 10.0::DOUBLE AS x, 1.0::DOUBLE AS r FROM part)""")
def _priors(spark: SparkSession, where: str) -> DataFrame:
    k, x = F.col("p_partkey"), (F.col("p_partkey") % 97 + 1) / 10.0
    return raw(spark, where, "part").select(k.alias("k"), r(params.ln_prior("gamma", x), 6, "gamma_"), r(params.ln_prior("var_log_nu", x), 6, "exponential"), r(params.ln_prior("mean_log_nu", x), 6, "normal"))


# ---- collapsed dimensions -------------------------------------------------------------------------------------------------------------------
@query("sv_a02_a05_f07_collapsed", with_base(f"""WITH x AS (SELECT c, max(y) = 1 AS x, max(l) = 1 AS link FROM cells GROUP BY c)
SELECT count(*) AS n_visited, round(sum(CASE WHEN x AND link THEN ln(0.7::DOUBLE) WHEN x THEN ln(0.3::DOUBLE) WHEN link THEN ln({EPSILON}::DOUBLE) ELSE ln(1 - {EPSILON}::DOUBLE) END) + ({_N} - count(*)) * ln(1 - {EPSILON}::DOUBLE), 4) AS log_likelihood FROM x""", "cells"))
def _collapsed(spark: SparkSession, where: str) -> DataFrame:
    likelihood.kept_dimensions(["r", "c"], ["c"])
    flat = raw(spark, where, "part").select(F.col("p_partkey").alias("leaf_ix"), F.lit(0.7).alias("effort"))
    n = shape_of(spark, where).n_cols
    return likelihood.collapsed_log_likelihood(y_of(spark, where), l_of(spark, where), ["c"], n, flat, "c", EPSILON).withColumn("log_likelihood", F.round("log_likelihood", 4))


@query("sv_a05_without_self", with_base("SELECT r, c, y = 1 AS state, n AS n_ones, (sum(y) OVER (PARTITION BY c)) - y > 0 AS x_without FROM cells", "cells"))
def _without(spark: SparkSession, where: str) -> DataFrame:
    return likelihood.collapsed_without_self(y_of(spark, where), ["c"])


# ---- states along branches ---------------------------------------------------------------------------------------------------------------------
_A, _V = "((clique % 7) + 1) / 10.0::DOUBLE", "((clique % 5) + 1) / 4.0::DOUBLE"
_BIN = "CAST((n.node_ix * 13) % 20 AS INT)"
_GRID = f"""{_STATES}, g AS (SELECT clique, {_A} AS alpha, {_V} AS nu, n.id, n.parent, {_BIN} AS bin FROM (SELECT p_partkey AS clique FROM part) q, sp_nodes n WHERE NOT n.is_root),
br AS (SELECT g.*, coalesce(s.state, false) AS state, coalesce(u.state, false) AS up FROM g LEFT JOIN st s ON s.clique = g.clique AND s.id = g.id LEFT JOIN st u ON u.clique = g.clique AND u.id = g.parent)"""


def sp_bins(spark: SparkSession, where: str) -> DataFrame:
    return tree(spark, where, "sp").withColumn("bin", ((F.col("node_ix") * 13) % 20).cast("int"))


def sp_cliques(spark: SparkSession, where: str) -> DataFrame:
    c = F.col("p_partkey")
    return raw(spark, where, "part").select(c.alias("clique"), ((c % 7 + 1) / 10.0).alias("alpha"), ((c % 5 + 1) / 4.0).alias("nu"))


@query("sv_j02_parent_states", with_base(f"WITH {_STATES} SELECT s.clique, s.id, n.parent, s.state, coalesce(u.state, false) AS parent_state FROM st s JOIN sp_nodes n ON n.id = s.id AND n.parent IS NOT NULL LEFT JOIN st u ON u.clique = s.clique AND u.id = n.parent", "sp", "cells"))
def _parents(spark: SparkSession, where: str) -> DataFrame:
    return field.with_parent_state(states(spark, where), tree(spark, where, "sp"))


@query("sv_j03_a06_children", with_base(f"WITH {_GRID} SELECT clique, parent AS id, round(sum({ln(p_of('alpha', 'nu', 'bin', 'false', 'state'))}), 5) AS log0, round(sum({ln(p_of('alpha', 'nu', 'bin', 'true', 'state'))}), 5) AS log1 FROM br GROUP BY 1, 2", "sp", "cells"))
def _children(spark: SparkSession, where: str) -> DataFrame:
    return field.sparse_child_log_sums(states(spark, where), sp_bins(spark, where), sp_cliques(spark, where), N_BINS).select("clique", "id", r("log0", 5, "log0"), r("log1", 5, "log1"))


@query("sv_a07_tree_log_likelihood", with_base(f"WITH {_GRID} SELECT clique, round(sum({ln(p_of('alpha', 'nu', 'bin', 'up', 'state'))}), 5) AS cur, round(sum({ln(p_of('0.5::DOUBLE', '(nu * 1.5::DOUBLE)', 'bin', 'up', 'state'))}), 5) AS try FROM br GROUP BY clique", "sp", "cells"))
def _tree_ll(spark: SparkSession, where: str) -> DataFrame:
    sp, cl = sp_bins(spark, where), sp_cliques(spark, where)
    got = field.sparse_log_likelihood(field.touched_counts(states(spark, where), sp, cl), cl, field.bulk_counts(sp, N_BINS), F.lit(0.5), F.col("nu") * 1.5)
    return got.select("clique", r("cur", 5, "cur"), r("try", 5, "try"))


_COND = f"""ch AS (SELECT clique, parent AS id, sum({ln(p_of('alpha', 'nu', 'bin', 'false', 'state'))}) AS l0, sum({ln(p_of('alpha', 'nu', 'bin', 'true', 'state'))}) AS l1 FROM br GROUP BY 1, 2),
cond AS (SELECT ch.clique, ch.id, b.state, l0 + {ln(p_of('b.alpha', 'b.nu', 'b.bin', 'b.up', 'false'))} AS log0, l1 + {ln(p_of('b.alpha', 'b.nu', 'b.bin', 'b.up', 'true'))} AS log1 FROM ch JOIN br b ON b.clique = ch.clique AND b.id = ch.id
UNION ALL SELECT ch.clique, ch.id, coalesce(s.state, false), l0 + ln(1 - (({_A}))), l1 + ln({_A}) FROM (SELECT ch.*, clique FROM ch) ch JOIN sp_nodes n ON n.id = ch.id AND n.is_root LEFT JOIN st s ON s.clique = ch.clique AND s.id = ch.id)""".replace("(SELECT ch.*, clique FROM ch) ch", "ch")


@query("sv_g05_conditionals", with_base(f"WITH {_GRID}, {_COND.replace('clique %', 'ch.clique %')} SELECT clique, id, state, round(log0, 5) AS log0, round(log1, 5) AS log1 FROM cond", "sp", "cells"))
def _conditionals(spark: SparkSession, where: str) -> DataFrame:
    got = field.sparse_full_conditionals(states(spark, where), sp_bins(spark, where), sp_cliques(spark, where), N_BINS)
    return got.select("clique", "id", "state", r("log0", 5, "log0"), r("log1", 5, "log1"))


@query("sv_a09_k07_densities", with_base(f"""WITH {_GRID}, {_COND.replace('clique %', 'ch.clique %')}
SELECT round((SELECT sum(CASE WHEN state THEN log1 ELSE log0 END) FROM cond), 2) AS pseudo_log_density,
round((SELECT sum({ln(p_of('alpha', 'nu', 'bin', 'up', 'state'))}) FROM br) + (SELECT sum(CASE WHEN s.state THEN ln(a) ELSE ln(1 - a) END) FROM (SELECT p_partkey AS clique, ((p_partkey % 7) + 1) / 10.0::DOUBLE AS a, n.id FROM part, sp_nodes n WHERE n.is_root) q LEFT JOIN st s ON s.clique = q.clique AND s.id = q.id), 2) AS joint_log_density""", "sp", "cells"))
def _densities(spark: SparkSession, where: str) -> DataFrame:
    st, bins, cl = states(spark, where), sp_bins(spark, where), sp_cliques(spark, where)
    pseudo = field.pseudo_log_density(field.sparse_full_conditionals(st, bins, cl, N_BINS)).scalar()
    joint = field.sparse_joint_log_density(field.touched_counts(st, bins, cl), st, bins, cl, field.bulk_counts(bins, N_BINS))
    return joint.select(r(pseudo, 2, "pseudo_log_density"), r("joint_log_density", 2, "joint_log_density"))


@query("sv_a04_ones", with_base("SELECT c AS clique, sum(y)::BIGINT AS n_ones FROM cells GROUP BY c", "cells"))
def _ones(spark: SparkSession, where: str) -> DataFrame:
    return field.ones_per_clique(y_of(spark, where), "c")


@query("sv_a04_changed_ones", with_base("SELECT c AS clique, sum(CASE WHEN n > 1 THEN 1 - y ELSE y END)::BIGINT AS n_ones FROM cells GROUP BY c", "cells"))
def _changed(spark: SparkSession, where: str) -> DataFrame:
    y = y_of(spark, where)
    flips = y.where("n_ones > 1").select("r", "c", F.col("state").alias("old"), (~F.col("state")).alias("new"))
    return field.changed_ones(field.ones_per_clique(y, "c"), flips, "c")


_PAIR = "pr AS (SELECT id, bin, (n.node_ix // 2)::VARCHAR AS pair, n.node_ix % 2 = 0 AS first FROM (SELECT n.*, CAST((n.node_ix * 13) % 20 AS INT) AS bin FROM sp_nodes n WHERE NOT n.is_root) n)"
_MOVE = """wd AS (SELECT pair, max(CASE WHEN first THEN id END) AS id_1, max(CASE WHEN NOT first THEN id END) AS id_2, max(CASE WHEN first THEN bin END) AS a, max(CASE WHEN NOT first THEN bin END) AS b FROM pr GROUP BY pair HAVING count(*) = 2),
mv AS (SELECT *, CASE WHEN a > 0 AND b < 19 AND a < 19 AND b > 0 THEN CASE WHEN {u} < 0.5 THEN -1 ELSE 1 END WHEN a > 0 AND b < 19 THEN -1 WHEN a < 19 AND b > 0 THEN 1 ELSE 0 END AS move FROM wd)"""


@query("sv_j13_a08_pair_ratios", with_base(f"""WITH {_GRID}, {_PAIR}, {_MOVE.format(u="0.25")}, bb AS (SELECT pair, id_1 AS id, move AS step FROM mv UNION ALL SELECT pair, id_2, -move FROM mv)
SELECT pair, round(sum({ln(p_of('alpha', 'nu', '(bin + step)', 'up', 'state'))} - {ln(p_of('alpha', 'nu', 'bin', 'up', 'state'))}), 4) AS log_ratio FROM bb JOIN br ON br.id = bb.id GROUP BY pair""", "sp", "cells"))
def _pair_ratios(spark: SparkSession, where: str) -> DataFrame:
    b = sp_bins(spark, where).where("not is_root")
    pairs = b.select(F.floor(F.col("node_ix") / 2).cast("string").alias("pair"), "id", "bin", (F.col("node_ix") % 2 == 0).alias("first"))
    moves = params.pair_moves(pairs, N_BINS, 0, 0, F.lit(0.25)).where("id_1 is not null and id_2 is not null")
    return params.state_pair_ratios(moves, states(spark, where), sp_bins(spark, where), sp_cliques(spark, where), N_BINS).withColumn("log_ratio", F.round("log_ratio", 4))


@query("sv_g11_moved_bins", with_base(f"WITH {nodes_sql('sp')}, {_PAIR}, {_MOVE.format(u=_u('pair::BIGINT', '5'))} SELECT pr.id, CAST(pr.bin + CASE WHEN pr.id = id_1 THEN move WHEN pr.id = id_2 THEN -move ELSE 0 END AS INT) AS bin FROM pr LEFT JOIN mv ON mv.pair = pr.pair", "sp"))
def _moved_bins(spark: SparkSession, where: str) -> DataFrame:
    """Bins after one accepted move of each pair, drawn from the steps that are allowed."""
    b = sp_bins(spark, where).where("not is_root")
    pairs = b.select(F.floor(F.col("node_ix") / 2).cast("string").alias("pair"), "id", "bin", (F.col("node_ix") % 2 == 0).alias("first"))
    moves = params.pair_moves(pairs, N_BINS, 1, 1, P.lattice(F.col("pair"), F.lit(5))).where("id_1 is not null and id_2 is not null")
    return params.moved_bins(b.select("id", "bin"), moves, moves.select("pair", F.lit(0.0).alias("log_ratio")), 1, 1)


@query("sv_g11_branch_pairs", with_base(f"WITH {nodes_sql('mo')} SELECT count(*) // 2 AS n_pairs, count(*) % 2 AS n_alone, 2 AS least, 2 AS most FROM mo_nodes WHERE NOT is_root", "mo"))
def _branch_pairs(spark: SparkSession, where: str) -> DataFrame:
    """All branches but one at most are in a pair of two."""
    b = tree(spark, where, "mo").where("not is_root").select("id", F.lit(0).alias("bin"))
    sizes = params.branch_pairs(b, 1, 1).groupBy("pair").agg(F.count_distinct("id").alias("n"))
    total = b.agg(F.count(F.lit(1))).scalar()
    return sizes.agg(F.count(F.lit(1)).alias("n_pairs"), F.min("n").alias("least"), F.max("n").alias("most")).select("n_pairs", (total - 2 * F.col("n_pairs")).alias("n_alone"), "least", "most")


# ---- sweeps --------------------------------------------------------------------------------------------------------------------------------------
_ROWS = f"""rw AS (SELECT c_custkey AS r, 'n' || c_nationkey AS up_id, c_custkey % 20 AS bin_r, er, ((c_custkey % 7) + 1) / 10.0::DOUBLE AS am, ((c_custkey % 5) + 1) / 4.0::DOUBLE AS vm FROM customer JOIN er ON er.r = c_custkey),
cl AS (SELECT p_partkey AS c, p_partkey % 20 AS bin_c, ec, ((p_partkey % 9) + 1) / 10.0::DOUBLE AS aa, ((p_partkey % 3) + 1) / 2.0::DOUBLE AS va FROM part JOIN ec ON ec.c = p_partkey)"""


def _weights(links: bool) -> str:
    """Log weights of cells in w (r, c)."""
    def side(s: str) -> str:
        obs = f" + {ln(f'CASE WHEN k.l = 1 THEN er * ec ELSE 1 - er * ec END' if s == 'true' else f'CASE WHEN k.l = 1 THEN {EPSILON}::DOUBLE ELSE 1 - {EPSILON}::DOUBLE END')}" if links else ""
        return f"{ln(p_of('aa', 'va', 'bin_r', 'coalesce(z.state, false)', s))} + {ln(p_of('am', 'vm', 'bin_c', 'false', s))}{obs}"

    return f"lw AS (SELECT w.r, w.c, coalesce(k.l = 1, false) AS link, {side('false')} AS l0, {side('true')} AS l1 FROM w JOIN rw ON rw.r = w.r JOIN cl ON cl.c = w.c JOIN sp_nodes n ON n.id = rw.up_id LEFT JOIN z ON z.internal_ix = n.internal_ix AND z.other_ix = w.c LEFT JOIN cells k ON k.r = w.r AND k.c = w.c)"


def _leaves(spark: SparkSession, where: str, up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and columns of the field without their efforts; ``up`` has (id, internal_ix)."""
    k, j = F.col("c_custkey"), F.col("p_partkey")
    up = up.select(F.col("id").alias("up_id"), F.col("internal_ix").alias("up_r"))
    rows = raw(spark, where, "customer").select(k.alias("r"), F.expr("'n' || c_nationkey").alias("up_id"), (k % 20).alias("bin_r"), ((k % 7 + 1) / 10.0).alias("alpha_m"), ((k % 5 + 1) / 4.0).alias("nu_m")).join(up, "up_id").drop("up_id")
    cols = raw(spark, where, "part").select(j.alias("c"), F.lit(0).cast("long").alias("up_c"), (j % 20).alias("bin_c"), ((j % 9 + 1) / 10.0).alias("alpha_s"), ((j % 3 + 1) / 2.0).alias("nu_s"))
    return rows, cols


def field_tables(spark: SparkSession, where: str, links: bool) -> field.Field:
    rows, cols = (t.join(e.withColumnRenamed("leaf_ix", k), k) for t, e, k in zip(_leaves(spark, where, tree(spark, where, "sp")), efforts(spark, where), "rc", strict=True))
    empty = spark.createDataFrame([], "internal_ix long, other_ix long, state boolean")
    return field.Field(shape_of(spark, where), N_BINS, rows, cols, z_sp(spark, where), empty, l_of(spark, where), EPSILON, links)


@query("sv_g01_j04_y_weights", with_base(f"WITH {nodes_sql('sp')}, z AS (SELECT * FROM zz), {_OCC}, {_ROWS}, w AS (SELECT r, c FROM cells), {_weights(True)} SELECT r, c, link, round(l0, 6) AS log0, round(greatest(l1, -1e9), 6) AS log1 FROM lw".replace("z AS (SELECT * FROM zz)", _STATES.split(", st AS")[0].split(f"{nodes_sql('sp')}, ")[1]), "sp", *_SRC))
def _y_weights(spark: SparkSession, where: str) -> DataFrame:
    got = field.y_log_weights(field_tables(spark, where, True), base(spark, where, "cells").select("r", "c"))
    return got.select("r", "c", "link", r("log0", 6, "log0"), r(F.greatest("log1", F.lit(-1e9)), 6, "log1"))


_ZSQL = _STATES.split(", st AS")[0].split(f"{nodes_sql('sp')}, ")[1]
_SWEEP = f"WITH {nodes_sql('sp')}, {_ZSQL}, {_OCC}, {_ROWS}, w AS (SELECT c_custkey AS r, p_partkey AS c FROM customer, part), {{0}}, dr AS (SELECT r, c, {_u('r', 'c')} < 1 / (1 + exp(l0 - l1)) AS s FROM lw) SELECT r, count(CASE WHEN s THEN 1 END) AS n_ones FROM dr GROUP BY r HAVING count(CASE WHEN s THEN 1 END) > 0"


def _counted(spark: SparkSession, where: str, links: bool) -> DataFrame:
    """Ones per row after a sweep. Order lines say which nations hold a part, and the links, without being made cells before."""
    cuts = Cuts(spark, "sweep")
    inner = cuts.save("inner", tree(spark, where, "sp").where("internal_ix is not null").select("id", "internal_ix"))
    rows, cols = _leaves(spark, where, inner)
    if links:
        papers = raw(spark, where, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("r")), raw(spark, where, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("c"))
        rows, cols = (t.join(p.agg(F.count(F.lit(1)).alias("n")), k, "left").withColumn(f"effort_{k}", P.effort(GAMMA, P.log_count("n"))).drop("n") for t, p, k in zip((rows, cols), papers, "rc", strict=True))
    else:
        rows, cols = rows.withColumn("effort_r", F.lit(0.0)), cols.withColumn("effort_c", F.lit(0.0))
    rows = cuts.save("rows", rows)
    orders = raw(spark, where, "orders").select("o_orderkey", F.col("o_custkey").alias("r")).join(rows.select("r", "up_r"), "r")
    lines = raw(spark, where, "lineitem").select("l_orderkey", F.col("l_partkey").alias("c"), (F.col("l_returnflag") != "R").alias("below"), (F.col("l_returnflag") != "N").alias("link"))
    marks = lines.where("below or link" if links else "below").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("up_r", "r", "c", "below", "link")
    empty = spark.createDataFrame([], "internal_ix long, other_ix long, state boolean")
    new = field.swept_counts(spark, field.Field(shape_of(spark, where), N_BINS, rows, cols, empty, empty, empty.select(F.col("internal_ix").alias("r"), F.col("other_ix").alias("c")), EPSILON, links), 0, marks)
    return new.where("n_ones > 0")


@query("sv_g02_g04_sweep", with_base(_SWEEP.format(_weights(True)), "sp", *_SRC))
def _sweep(spark: SparkSession, where: str) -> DataFrame:
    """Ones per row after a sweep over every cell of the full grid."""
    return _counted(spark, where, True)


@query("sv_g18_simulated_y", with_base(_SWEEP.format(_weights(False)), "sp", *_SRC))
def _simulated_y(spark: SparkSession, where: str) -> DataFrame:
    return _counted(spark, where, False)


@query("sv_g20_k08_simulated_links", with_base(f"WITH {_OCC} SELECT er.r, count(*) AS n FROM er, ec LEFT JOIN cells k ON k.r = er.r AND k.c = ec.c WHERE {_u('er.r', 'ec.c', 3)} < CASE WHEN k.y = 1 THEN er * ec ELSE {EPSILON}::DOUBLE END GROUP BY er.r".replace("FROM er, ec LEFT JOIN", "FROM (er CROSS JOIN ec) LEFT JOIN"), *_SRC))
def _simulated_links(spark: SparkSession, where: str) -> DataFrame:
    er, ec = efforts(spark, where)
    rows, cols = er.withColumnRenamed("leaf_ix", "r"), ec.withColumnRenamed("leaf_ix", "c")
    drawn = field.drawn_links(spark, shape_of(spark, where), y_of(spark, where), rows, cols, EPSILON, P.lattice("r", "c", 3))
    return drawn.groupBy("r").agg(F.count(F.lit(1)).alias("n"))


def _cliques(spark: SparkSession, where: str, step: Callable, with_z: bool) -> DataFrame:
    """The inner states of all cliques after a step, from the leaves that are one and, ``with_z``, from the stored Z."""
    sp = Cuts(spark, "nodes").save("nodes", sp_bins(spark, where))
    coded = field.node_codes(sp.join(sp.where("kind <> 'leaf'").select(F.col("id").alias("parent"), F.col("node_ix").alias("parent_ix")), "parent", "left"), N_BINS)
    ones = y_of(spark, where).where("state").join(coded.where("kind = 'leaf'").select(F.col("leaf_ix").alias("r"), "code"), "r").select(F.col("c").alias("clique"), "code")
    if with_z:
        z = z_sp(spark, where).where("state").join(coded.select("internal_ix", "code"), "internal_ix")
        ones = ones.unionByName(z.select(F.col("other_ix").alias("clique"), "code"))
    return field.update_inner(spark, sp_cliques(spark, where), ones, field.InnerTree.of(coded, N_BINS), step).where("node_ix >= 0").select("clique", "node_ix", "state")


def _level(up: str) -> str:
    return f"SELECT clique, parent AS id, sum({ln(p_of('alpha', 'nu', 'bin', 'true', 'state'))}) > sum({ln(p_of('alpha', 'nu', 'bin', 'false', 'state'))}) AS state FROM {up} GROUP BY 1, 2"


@query("sv_g07_g08_likeliest_z", with_base(f"""WITH {_GRID}, l1 AS ({_level("(SELECT * FROM br WHERE id LIKE 'c%')")}),
l0 AS ({_level("(SELECT g.*, l1.state FROM g JOIN l1 ON l1.clique = g.clique AND l1.id = g.id)")})
SELECT clique, node_ix, state FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l0) x JOIN sp_nodes n ON n.id = x.id""", "sp", "cells"))
def _likeliest(spark: SparkSession, where: str) -> DataFrame:
    return _cliques(spark, where, field.likeliest_cliques, False)


@query("sv_g17_simulated_z", with_base(f"""WITH {_GRID},
q AS (SELECT p_partkey AS clique, n.id, n.node_ix, {_u('n.node_ix', 'p_partkey')} < ((p_partkey % 7) + 1) / 10.0::DOUBLE AS state FROM part, sp_nodes n WHERE n.is_root),
k AS (SELECT g.clique, n.id, n.node_ix, {_u('n.node_ix', 'g.clique')} < {p_of('alpha', 'nu', 'bin', 'q.state', 'true')} AS state FROM g JOIN sp_nodes n ON n.id = g.id AND n.kind = 'internal' JOIN q ON q.clique = g.clique AND q.id = g.parent)
SELECT clique, node_ix, state FROM q UNION ALL SELECT clique, node_ix, state FROM k""", "sp", "cells"))
def _simulated_z(spark: SparkSession, where: str) -> DataFrame:
    return _cliques(spark, where, field.simulated_cliques, False)


@query("sv_g05_g06_gibbs_z", with_base(f"""WITH {_GRID}, {_COND.replace('clique %', 'ch.clique %')},
q AS (SELECT cond.clique, cond.id, n.node_ix, {_u('n.node_ix', 'cond.clique')} < 1 / (1 + exp(log0 - log1)) AS state FROM cond JOIN sp_nodes n ON n.id = cond.id AND n.is_root),
k AS (SELECT b.clique, b.id, n.node_ix, {_u('n.node_ix', 'b.clique')} < 1 / (1 + exp(l0 + {ln(p_of('alpha', 'nu', 'bin', 'q.state', 'false'))} - l1 - {ln(p_of('alpha', 'nu', 'bin', 'q.state', 'true'))})) AS state
      FROM br b JOIN sp_nodes n ON n.id = b.id AND n.kind = 'internal' JOIN ch ON ch.clique = b.clique AND ch.id = b.id JOIN q ON q.clique = b.clique AND q.id = b.parent)
SELECT clique, node_ix, state FROM q UNION ALL SELECT clique, node_ix, state FROM k""", "sp", "cells"))
def _gibbs(spark: SparkSession, where: str) -> DataFrame:
    return _cliques(spark, where, field.gibbs_cliques, True)


_TRY = f"""w AS (SELECT clique, step, log_nu, z, CASE WHEN step = 'alpha' THEN CASE WHEN f > 1 THEN 2 - f ELSE f END ELSE alpha END AS a_new, CASE WHEN step = 'log_nu' THEN log_nu + 0.1::DOUBLE * z ELSE log_nu END  AS v_new, alpha
 FROM (SELECT *, (abs(alpha + 0.1::DOUBLE * z)) % 2.0::DOUBLE AS f FROM (SELECT p_partkey AS clique, {_A.replace('clique', 'p_partkey')} AS alpha, ln({_V.replace('clique', 'p_partkey')}) AS log_nu, 4 * {_u('p_partkey', '21')} - 2 AS z, unnest(['alpha', 'log_nu']) AS step FROM part) q) q2),
rt AS (SELECT w.clique, w.step, sum({ln(p_of('w.a_new', 'exp(w.v_new)', 'bin', 'up', 'state'))} - {ln(p_of('br.alpha', 'br.nu', 'bin', 'up', 'state'))}) AS d FROM w JOIN br ON br.clique = w.clique GROUP BY 1, 2),
dc AS (SELECT w.*, ln({_u('w.clique', '22')}) < d + CASE WHEN w.step = 'log_nu' THEN (log_nu * log_nu - v_new * v_new) / 2 ELSE 0 END AS accepted FROM w JOIN rt ON rt.clique = w.clique AND rt.step = w.step)"""


@query("sv_g09_g10_proposals", with_base(f"WITH {_GRID}, {_TRY} SELECT clique, step, accepted, round(CASE WHEN accepted THEN a_new ELSE alpha END, 9) AS alpha, round(CASE WHEN accepted THEN v_new ELSE log_nu END, 9) AS log_nu FROM dc", "sp", "cells"))
def _proposals(spark: SparkSession, where: str) -> DataFrame:
    """One step of alpha and of log_nu in every clique of the species tree, with what was accepted."""
    start = sp_cliques(spark, where).withColumn("log_nu", F.log("nu"))
    z, u = 4 * P.lattice("clique", F.lit(21)) - 2, P.lattice("clique", F.lit(22))
    sp = sp_bins(spark, where)
    counts, out = field.bulk_counts(sp, N_BINS), None
    for name, propose in (("alpha", params.proposed_alpha), ("log_nu", params.proposed_log_nu)):
        tries = propose(start, 0.1, 1, 1, z)
        touched = field.touched_counts(states(spark, where), sp, start)
        done = params.decide_cliques(tries, params.clique_ratios(touched, tries, counts), name, 1, 1, u=u)
        done = done.select("clique", F.lit(name).alias("step"), "accepted", r("alpha", 9, "alpha"), r("log_nu", 9, "log_nu"))
        out = done if out is None else out.unionByName(done)
    return out


@query("sv_g15_hyper_ratio", f"""WITH c AS (SELECT ln({_V.replace('clique', 'p_partkey')}) AS x FROM part), m AS (SELECT count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM c),
p AS (SELECT n, s, q, -0.5::DOUBLE * n * ln(2 * pi() * 1.3::DOUBLE) - (q - 2 * 0.2::DOUBLE * s + n * 0.04::DOUBLE) / 2.6::DOUBLE - 0.04::DOUBLE / 4 - 1.3::DOUBLE AS new, -0.5::DOUBLE * n * ln(2 * pi()) - q / 2 - 1 AS old FROM m)
SELECT n AS n_cliques, round(s, 6) AS sum_log_nu, round(q, 6) AS sum_squares, round(new - old, 6) AS log_ratio FROM p""")
def _hyper(spark: SparkSession, where: str) -> DataFrame:
    """The log posterior of mean and variance (0.2, 1.3) of log_nu, less that of (0, 1), from the moments over all cliques."""
    moments = params.log_nu_moments(sp_cliques(spark, where).withColumn("log_nu", F.log("nu")))
    row = (moments[0], *(round(x, 6) for x in (*moments[1:], params.hyper_log_ratio(moments, (0.0, 1.0), (0.2, 1.3)))))
    return spark.createDataFrame([row], "n_cliques long, sum_log_nu double, sum_squares double, log_ratio double")


# ---- spectra -------------------------------------------------------------------------------------------------------------------------------------
def ms(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """runs, candidates, unknowns, assigned, filters."""
    features = base(spark, where, "features")
    cands = features.join(base(spark, where, "parts_of"), "run").select("run", "feature", "molecule", "bin")
    return base(spark, where, "runs"), cands, features.withColumn("bin", F.lit(60)), base(spark, where, "assigned"), base(spark, where, "filters")


_CANDS = "cd AS (SELECT f.run, f.feature, p.molecule, p.bin FROM features f JOIN parts_of p ON p.run = f.run)"


@query("sv_j08_free_candidates", with_base(f"WITH {_CANDS} SELECT run, molecule, feature, bin FROM cd WHERE (run, molecule) NOT IN (SELECT (run, molecule) FROM assigned WHERE molecule IS NOT NULL)", "assigned"))
def _free(spark: SparkSession, where: str) -> DataFrame:
    _, cands, _, assigned, _ = ms(spark, where)
    return msms.free_candidates(cands, assigned)


@query("sv_j09_j10_lookups", with_base(f"WITH {_CANDS}, w AS (SELECT run, feature, molecule + feature % 2 AS molecule FROM assigned WHERE molecule IS NOT NULL) SELECT w.run, w.feature, w.molecule, cd.bin, (w.run, w.molecule) IN (SELECT (run, molecule) FROM assigned WHERE molecule IS NOT NULL) AS taken FROM w JOIN cd ON cd.run = w.run AND cd.feature = w.feature AND cd.molecule = w.molecule", "assigned"))
def _candidate(spark: SparkSession, where: str) -> DataFrame:
    _, cands, _, assigned, _ = ms(spark, where)
    wanted = assigned.where("molecule is not null").select("run", "feature", (F.col("molecule") + F.col("feature") % 2).alias("molecule"))
    found = msms.candidate_of_feature(cands, wanted)
    taken = msms.assigned_in_run(assigned, found.select("run", "molecule").distinct()).withColumn("taken", F.lit(True))
    return found.join(taken, ["run", "molecule"], "left").fillna({"taken": False}).select("run", "feature", "molecule", "bin", "taken")


@query("sv_f05_a12_kinds", with_base("SELECT run, count(molecule) AS n_real, count(*) - count(molecule) AS n_unknown FROM assigned GROUP BY run", "assigned"))
def _kinds(spark: SparkSession, where: str) -> DataFrame:
    return msms.assignment_kinds(ms(spark, where)[3])


@query("sv_a12_o01_present", with_base("SELECT r AS species, list(c ORDER BY c) AS molecules FROM cells WHERE y = 1 GROUP BY r", "cells"))
def _present(spark: SparkSession, where: str) -> DataFrame:
    return msms.present_per_species(y_of(spark, where))


@query("sv_o01_g28_nested", with_base(f"WITH {_CANDS} SELECT run, feature, list(molecule ORDER BY molecule) AS molecules, list(bin ORDER BY molecule) AS bins FROM cd GROUP BY 1, 2", "assigned"))
def _nested(spark: SparkSession, where: str) -> DataFrame:
    return msms.nested(ms(spark, where)[1]).select("run", "feature", F.col("candidates.molecule").alias("molecules"), F.col("candidates.bin").alias("bins"))


_SPECIAL = """sc AS (SELECT coalesce(p.run, a.run) AS run, coalesce(p.molecule, a.molecule) AS molecule, p.run IS NOT NULL AS y, a.run IS NOT NULL AS ms FROM (SELECT runs.run, cells.c AS molecule FROM runs JOIN cells ON cells.r = runs.species AND cells.y = 1) p
FULL JOIN (SELECT run, molecule FROM assigned WHERE molecule IS NOT NULL) a ON a.run = p.run AND a.molecule = p.molecule),
sd AS (SELECT sc.*, runs.species, runs.filter, coalesce(f.index, 128) AS ix FROM sc JOIN runs ON runs.run = sc.run LEFT JOIN filters f ON f.filter = runs.filter AND f.molecule = sc.molecule)"""
_MS = ("assigned", "runs", "cells", "filters")


@query("sv_j07_f04_special", with_base(f"WITH {_SPECIAL} SELECT run, species, filter, molecule, y, ms FROM sd", *_MS))
def _special(spark: SparkSession, where: str) -> DataFrame:
    runs, _, _, assigned, _ = ms(spark, where)
    return msms.special_cells(y_of(spark, where), runs, assigned)


@query("sv_a11_ms_log_likelihood", with_base(f"""WITH {_SPECIAL}, ft AS (SELECT run, sum({ln('1 - pow(1.1::DOUBLE, -bin / 10.0::DOUBLE)')}) AS lf FROM assigned GROUP BY run),
dt AS (SELECT run, count(*) AS n, sum({ln('CASE WHEN y AND ms THEN ix / 255.0::DOUBLE WHEN y THEN 1 - ix / 255.0::DOUBLE WHEN ms THEN 0.001::DOUBLE ELSE 0.999::DOUBLE END')}) AS ld FROM sd GROUP BY run)
SELECT ft.run, coalesce(n, 0) AS n_special, round(lf + coalesce(ld, 0) + ({_N} - coalesce(n, 0)) * ln(0.999::DOUBLE), 5) AS log_likelihood FROM ft LEFT JOIN dt ON dt.run = ft.run""", *_MS))
def _ms_ll(spark: SparkSession, where: str) -> DataFrame:
    runs, _, _, assigned, filters = ms(spark, where)
    got = msms.log_likelihood(y_of(spark, where), runs, assigned, filters, shape_of(spark, where).n_cols, 0.001)
    return got.withColumn("log_likelihood", F.round("log_likelihood", 5))


@query("sv_g32_contamination", with_base(f"""WITH {_SPECIAL}, q AS (SELECT sd.* FROM sd WHERE run IN (SELECT run FROM assigned)), n AS (SELECT count(*) AS k FROM runs WHERE run IN (SELECT run FROM assigned))
SELECT round(count(CASE WHEN NOT y AND ms THEN 1 END) * (ln(0.002::DOUBLE) - ln(0.001::DOUBLE)) + ((SELECT k FROM n) * {_N} - count(CASE WHEN y THEN 1 END) - count(CASE WHEN NOT y AND ms THEN 1 END)) * (ln(0.998::DOUBLE) - ln(0.999::DOUBLE)), 4) AS log_ratio FROM q""", *_MS))
def _contamination(spark: SparkSession, where: str) -> DataFrame:
    runs, _, _, assigned, _ = ms(spark, where)
    return msms.contamination_ratio(y_of(spark, where), runs, assigned, shape_of(spark, where).n_cols, 0.001, 0.002).withColumn("log_ratio", F.round("log_ratio", 4))


@query("sv_g31_filters", with_base(f"""WITH {_SPECIAL}, h AS (SELECT filter, molecule, count(CASE WHEN ms THEN 1 END) AS hit, count(CASE WHEN NOT ms THEN 1 END) AS miss FROM sd WHERE y GROUP BY 1, 2)
SELECT f.filter, f.molecule, round(coalesce(hit, 0) * (ln(200 / 255.0::DOUBLE) - ln(f.index / 255.0::DOUBLE)) + CASE WHEN coalesce(miss, 0) > 0 THEN miss * (ln(1 - 200 / 255.0::DOUBLE) - {ln('1 - f.index / 255.0::DOUBLE')}) ELSE 0 END, 5) AS log_ratio
FROM filters f LEFT JOIN h ON h.filter = f.filter AND h.molecule = f.molecule WHERE f.index < 255""", *_MS))
def _filters(spark: SparkSession, where: str) -> DataFrame:
    runs, _, _, assigned, filters = ms(spark, where)
    proposed = filters.where("index < 255").select("filter", "molecule", F.lit(200).alias("new"))
    return msms.filter_ratios(y_of(spark, where), runs, assigned, filters, proposed).withColumn("log_ratio", F.round("log_ratio", 5))


@query("sv_j11_j12_cells", with_base(f"""WITH w AS (SELECT r, c FROM cells), t AS (SELECT w.r, w.c, a.run IS NOT NULL AS ms, coalesce(f.index, 128) / 255.0::DOUBLE AS f FROM w JOIN runs ON runs.species = w.r LEFT JOIN (SELECT run, molecule FROM assigned WHERE molecule IS NOT NULL) a ON a.run = runs.run AND a.molecule = w.c
LEFT JOIN filters f ON f.filter = runs.filter AND f.molecule = w.c) SELECT r, c, round(sum(CASE WHEN ms THEN ln(0.001::DOUBLE) ELSE ln(0.999::DOUBLE) END), 5) AS log0, round(greatest(sum({ln('CASE WHEN ms THEN f ELSE 1 - f END')}), -1e9), 5) AS log1 FROM t GROUP BY r, c""", *_MS))
def _cell_ratio(spark: SparkSession, where: str) -> DataFrame:
    runs, _, _, assigned, filters = ms(spark, where)
    got = msms.cell_log_ratio(y_of(spark, where), runs, assigned, filters, 0.001)
    return got.select("r", "c", r("log0", 5, "log0"), r(F.greatest("log1", F.lit(-1e9)), 5, "log1"))


@query("sv_g22_g30_moves", with_base("SELECT count(*) AS n_features, 0 AS twice, 0 AS not_candidates FROM features", "features"))
def _moves(spark: SparkSession, where: str) -> DataFrame:
    """Twenty moves in every run; what must hold afterwards. They are made once and written, as three sums read them."""
    runs, cands, unknowns, assigned, filters = ms(spark, where)
    moved = msms.updated_assignments(cands, unknowns, msms.all_unknown(unknowns), runs, y_of(spark, where), filters, 0.001, 42, 1, 20)
    new = Cuts(spark, "moves").save("moved", moved)
    twice = msms.molecules_twice(new).agg(F.count(F.lit(1)).cast("int")).scalar()
    strange = new.where("molecule is not null").join(cands, ["run", "feature", "molecule", "bin"], "left_anti").agg(F.count(F.lit(1)).cast("int")).scalar()
    return new.agg(F.count(F.lit(1)).alias("n_features")).select("n_features", twice.alias("twice"), strange.alias("not_candidates"))


def _phred(b: str) -> str:
    return ln(f"1 - pow(1.1::DOUBLE, -{b} / 10.0::DOUBLE)")


def _shift(m: str, i: str) -> str:
    """ln P(assigned) - ln P(not assigned) of a molecule, null for none."""
    f = f"(coalesce({i}.index, 128) / 255.0::DOUBLE)"
    return f"CASE WHEN {m} IS NULL THEN 0 WHEN {i}.y THEN {ln(f)} - {ln(f'1 - {f}')} ELSE ln(0.001::DOUBLE) - ln(0.999::DOUBLE) END"


# one move in every run: pick, candidate or partner, ratio, decision
_ONE_MOVE = f"""u AS (SELECT run, {', '.join(f"{_u('run', str(k))} AS u{k}" for k in range(4))} FROM (SELECT DISTINCT run FROM features)),
st AS (SELECT run, feature, molecule, bin, molecule IS NOT NULL AS real, row_number() OVER (PARTITION BY run, molecule IS NOT NULL ORDER BY feature) - 1 AS k, count(molecule) OVER (PARTITION BY run) AS n_real, count(*) OVER (PARTITION BY run) AS n FROM assigned),
fr AS (SELECT cd.*, row_number() OVER (PARTITION BY cd.run, cd.feature ORDER BY cd.molecule) - 1 AS k, count(*) OVER (PARTITION BY cd.run, cd.feature) AS n_free FROM cd WHERE (run, molecule) NOT IN (SELECT (run, molecule) FROM assigned WHERE molecule IS NOT NULL)),
one AS (SELECT st.*, u.u2, u.u3, CAST(floor(u0 * 4) AS INT) AS kind, n_real, n - n_real AS n_unknown FROM st JOIN u ON u.run = st.run
        WHERE real = (floor(u0 * 4) <> 1) AND st.k = floor(u1 * CASE WHEN floor(u0 * 4) = 1 THEN n - n_real ELSE n_real END)),
num AS (SELECT one.run, coalesce(max(fr.n_free), 0) AS n_free FROM one LEFT JOIN fr ON fr.run = one.run AND fr.feature = one.feature GROUP BY one.run),
two AS (SELECT o.run, o.feature AS i, st.feature AS j, st.molecule AS mj, st.bin AS bj FROM one o JOIN st ON st.run = o.run AND st.real AND st.feature <> o.feature WHERE o.kind = 2
        AND st.k - CASE WHEN st.k > o.k THEN 1 ELSE 0 END = floor(o.u2 * (o.n_real - 1))),
ch AS (SELECT one.run, one.feature, CAST(NULL AS BIGINT) AS molecule, 60 AS bin, one.molecule AS old, one.bin AS old_bin, ln(n_real / ((n_unknown + 1.0::DOUBLE) * (n_free + 1))) AS q FROM one JOIN num ON num.run = one.run WHERE kind = 0
 UNION ALL SELECT one.run, one.feature, fr.molecule, fr.bin, one.molecule, one.bin, CASE WHEN kind = 1 THEN ln(n_unknown * fr.n_free / (n_real + 1.0::DOUBLE)) ELSE 0 END FROM one JOIN fr ON fr.run = one.run AND fr.feature = one.feature AND fr.k = floor(u2 * n_free) WHERE kind IN (1, 3)
 UNION ALL SELECT one.run, one.feature, mj, a.bin, one.molecule, one.bin, 0 FROM one JOIN two ON two.run = one.run JOIN cd a ON a.run = one.run AND a.feature = i AND a.molecule = mj JOIN cd b ON b.run = one.run AND b.feature = j AND b.molecule = one.molecule
 UNION ALL SELECT one.run, j, one.molecule, b.bin, mj, bj, 0 FROM one JOIN two ON two.run = one.run JOIN cd a ON a.run = one.run AND a.feature = i AND a.molecule = mj JOIN cd b ON b.run = one.run AND b.feature = j AND b.molecule = one.molecule),
info AS (SELECT DISTINCT cd.run, cd.molecule, coalesce(k.y = 1, false) AS y, f.index FROM cd JOIN runs ON runs.run = cd.run LEFT JOIN cells k ON k.r = runs.species AND k.c = cd.molecule LEFT JOIN filters f ON f.filter = runs.filter AND f.molecule = cd.molecule),
rt AS (SELECT ch.run, sum({_phred('ch.bin')} - {_phred('ch.old_bin')}) + sum({_shift('ch.molecule', 'a')}) - sum({_shift('ch.old', 'b')}) + max(q) AS d
       FROM ch LEFT JOIN info a ON a.run = ch.run AND a.molecule = ch.molecule LEFT JOIN info b ON b.run = ch.run AND b.molecule = ch.old GROUP BY ch.run),
ok AS (SELECT ch.* FROM ch JOIN rt ON rt.run = ch.run JOIN u ON u.run = ch.run WHERE ln(u3) < d)"""


@query("sv_g22_g30_one_move", with_base(f"WITH {_CANDS}, {_ONE_MOVE} SELECT st.run, st.feature, CASE WHEN ok.run IS NULL THEN st.molecule ELSE ok.molecule END AS molecule, coalesce(ok.bin, st.bin) AS bin FROM st LEFT JOIN ok ON ok.run = st.run AND ok.feature = st.feature", *_MS, "features", "parts_of"))
def _one_move(spark: SparkSession, where: str) -> DataFrame:
    """One move in every run, proposed and decided by numbers that SQL has too."""
    runs, cands, unknowns, assigned, filters = ms(spark, where)
    known = runs.join(cands.select("run").distinct(), "run", "left_semi")
    return msms.updated_assignments(cands, unknowns, assigned, known, y_of(spark, where), filters, 0.001, 0, 0, 1, msms.lattice_run_uniforms)


@query("sv_u05_changed_molecules", with_base("""SELECT 'gone' AS change, run, molecule FROM assigned WHERE molecule IS NOT NULL AND bin > 150
UNION ALL SELECT 'come', run, molecule + 1000000 FROM assigned WHERE molecule IS NOT NULL AND bin > 150""", "assigned"))
def _changed_molecules(spark: SparkSession, where: str) -> DataFrame:
    old = ms(spark, where)[3]
    new = old.withColumn("molecule", F.when(F.col("bin") > 150, F.col("molecule") + 1_000_000).otherwise(F.col("molecule")))
    gone, come = msms.changed_molecules(old, new)
    return gone.select(F.lit("gone").alias("change"), "*").unionByName(come.select(F.lit("come").alias("change"), "*"))


# ---- reports ---------------------------------------------------------------------------------------------------------------------------------------
@query("sv_j14_a13_transition_density", with_base(f"""WITH {_STATES}, lf AS (SELECT DISTINCT child FROM sp WHERE child NOT IN (SELECT parent FROM sp)),
f AS (SELECT sp.child IN (SELECT child FROM lf) AS leaf, CASE WHEN a.state <> b.state THEN 1.0::DOUBLE ELSE 0 END AS d FROM sp JOIN st a ON a.id = sp.child JOIN st b ON b.id = sp.parent AND b.clique = a.clique)
SELECT (SELECT count(DISTINCT clique) FROM st) AS n_cliques, (SELECT count(*) FROM sp) AS n_branches, (SELECT count(*) FROM lf) AS n_leaf_branches, (SELECT count(*) FROM sp) - (SELECT count(*) FROM lf) AS n_internal_branches, count(*) AS matched_pairs,
round(count(*) / ((SELECT count(*) FROM sp) * (SELECT count(DISTINCT clique) FROM st))::DOUBLE, 9) AS coverage, round(avg(d), 9) AS density_overall, round(avg(CASE WHEN leaf THEN d END), 9) AS density_leaf, round(avg(CASE WHEN NOT leaf THEN d END), 9) AS density_internal FROM f""", "sp", "cells"))
def _density(spark: SparkSession, where: str) -> DataFrame:
    got = analysis.transition_density(base(spark, where, "sp"), states(spark, where).withColumnRenamed("id", "node"))
    return got.withColumns({c: F.round(c, 9) for c in ("coverage", "density_overall", "density_leaf", "density_internal")})


_PRED = "pp AS (SELECT t.o_custkey * 100000 + t.o_orderkey % 97 AS position, t.s AS truth, coalesce(q.p, 0) AS predicted FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END AS s FROM orders) t LEFT JOIN (SELECT o_orderkey, (o_custkey * 31 % 101) / 100.0::DOUBLE AS p FROM orders WHERE o_orderpriority <> '1-URGENT') q ON q.o_orderkey = t.o_orderkey)"


def predictions(spark: SparkSession, where: str) -> DataFrame:
    orders = raw(spark, where, "orders")
    truth = orders.select(F.col("o_orderkey").alias("position"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("truth"))
    pred = orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("position"), ((F.col("o_custkey") * 31 % 101) / 100.0).alias("predicted"))
    return analysis.with_predictions(truth, pred)


@query("sv_j16_a14_agreement", f"WITH {_PRED} SELECT count(*) AS n, round(avg(abs(truth - predicted)), 9) AS mae, round(avg(pow(truth - predicted, 2)), 9) AS mse, round(corr(truth, predicted), 9) AS pearson, round(sum(truth * predicted) / (sqrt(sum(truth * truth)) * sqrt(sum(predicted * predicted))), 9) AS cosine FROM pp")
def _agreement(spark: SparkSession, where: str) -> DataFrame:
    return analysis.agreement(predictions(spark, where)).select("n", *(r(c, 9, c) for c in ("mae", "mse", "pearson", "cosine")))


@query("sv_a15_c22_calibration", f"WITH {_PRED} SELECT CAST(least(floor(predicted * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(predicted), 9) AS mean_predicted, round(avg(truth), 9) AS mean_truth FROM pp GROUP BY 1")
def _calibration(spark: SparkSession, where: str) -> DataFrame:
    return analysis.calibration(predictions(spark, where)).select("bin", "n", r("mean_predicted", 9, "mean_predicted"), r("mean_truth", 9, "mean_truth"))


@query("sv_a18_k09_posterior_summary", "SELECT event_type AS name, round(avg(value), 6) AS post_mean, round(var_samp(value), 6) AS post_var, round(stddev_samp(value), 6) AS post_sd, count(*) AS n FROM events GROUP BY 1")
def _posterior(spark: SparkSession, where: str) -> DataFrame:
    got = params.posterior_summary(raw(spark, where, "events").select(F.col("event_type").alias("name"), "value"))
    return got.select("name", r("post_mean", 6, "post_mean"), r("post_var", 6, "post_var"), r("post_sd", 6, "post_sd"), "n")


@query("sv_j15_u02_u03_true_inferred", """WITH t AS (SELECT 'c' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 7.5::DOUBLE ELSE c_acctbal END AS value FROM customer), p AS (SELECT 'c' || o_custkey AS name, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1 HAVING count(*) > 1)
SELECT t.name, t.value, round(m, 4) AS post_mean, round(v, 2) AS post_var, round(sqrt(greatest(v, 0)), 4) AS post_sd FROM t JOIN p ON p.name = t.name""")
def _inferred(spark: SparkSession, where: str) -> DataFrame:
    c = raw(spark, where, "customer")
    first = c.select(F.expr("'c' || c_custkey").alias("name"), F.col("c_acctbal").alias("value"))
    truth = params.last_by_name([first, c.where("c_custkey % 3 = 0").select(F.expr("'c' || c_custkey").alias("name"), F.lit(7.5).alias("value"))])
    post = params.posterior_summary(raw(spark, where, "orders").select(F.expr("'c' || o_custkey").alias("name"), F.col("o_totalprice").alias("value"))).where("n > 1")
    got = analysis.true_against_inferred(truth, post)
    return got.select("name", "value", r("post_mean", 4, "post_mean"), r("post_var", 2, "post_var"), r("post_sd", 4, "post_sd"))


_EDGES = "e AS (SELECT feature, molecule, max(score) AS score FROM edges WHERE feature IS NOT NULL AND molecule IS NOT NULL AND score > 0 AND isfinite(score) GROUP BY 1, 2)"


def best(spark: SparkSession, where: str) -> DataFrame:
    return matching.best_edges(matching.read_edges(raw(spark, where, "edges")))


@query("sv_j17_encoded", f"WITH {_EDGES} SELECT dense_rank() OVER (ORDER BY feature) - 1 AS row, dense_rank() OVER (ORDER BY molecule) - 1 AS col, score, feature, molecule FROM e")
def _encoded(spark: SparkSession, where: str) -> DataFrame:
    return matching.encoded(best(spark, where))


@query("sv_a17_edge_summary", f"WITH {_EDGES} SELECT count(DISTINCT feature) AS n_features, count(DISTINCT molecule) AS n_molecules, count(*) AS n_edges, round(100.0::DOUBLE * count(*) / (count(DISTINCT feature) * count(DISTINCT molecule)), 9) AS density_percent FROM e")
def _edge_summary(spark: SparkSession, where: str) -> DataFrame:
    return matching.edge_summary(best(spark, where)).withColumn("density_percent", F.round("density_percent", 9))


@query("sv_g35_j18_f09_assignment")
def _assignment(spark: SparkSession, where: str) -> DataFrame:
    """Features and their molecules in a matching of the largest total score."""
    return matching.assign(best(spark, where), 0.3)


@query("sv_a16_k12_k13_assignment_summary")
def _assignment_summary(spark: SparkSession, where: str) -> DataFrame:
    return matching.assignment_summary(matching.assign(best(spark, where), 0.3))


@query("sv_o04_head", f"WITH {_EDGES} SELECT feature, molecule, score FROM e ORDER BY score DESC, feature, molecule LIMIT 20")
def _head(spark: SparkSession, where: str) -> DataFrame:
    return best(spark, where).orderBy(F.desc("score"), "feature", "molecule").limit(20)


@query("sv_o05_subsample", f"WITH q AS (SELECT o_orderkey AS position, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END AS truth, CASE WHEN o_orderpriority <> '1-URGENT' THEN (o_custkey * 31 % 101) / 100.0::DOUBLE ELSE 0 END AS predicted FROM orders) SELECT * FROM q ORDER BY {_u('position', '7')}, position LIMIT 500")
def _subsample(spark: SparkSession, where: str) -> DataFrame:
    """Points of a plot: 500 rows without replacement."""
    return analysis.subsample(predictions(spark, where), 500, "position", u=P.lattice("position", F.lit(7)))

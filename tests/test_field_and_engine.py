import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import prob as P
from cladewise.operators import analysis, field, likelihood, matching, msms, params, sparse
from cladewise.plans import engine
from cladewise.sources import synthetic

EDGES = "child string, parent string, length double, ord long"


def test_closed_form_equals_the_exponential(spark):
    for alpha, nu in ((0.2, 0.7), (0.5, 3.0), (0.9, 12.0)):
        q = nu * np.array([[-alpha, alpha], [1 - alpha, -(1 - alpha)]])
        df = spark.range(20).select("id", *(x.alias(k) for k, x in P.transition(F.lit(alpha), F.lit(nu), "id", 20).items())).collect()
        for r in df:
            step = np.eye(2) + q * P.delta(20) * (r.id + 0.5) / 2**20
            for _ in range(20):
                step = step @ step
            assert np.allclose([[r.p00, r.p01], [r.p10, r.p11]], step, atol=1e-5)
    far = spark.range(1).select(P.transition(F.lit(0.3), F.lit(25.1), F.lit(0), 20)["p01"].alias("p")).first().p
    assert far == pytest.approx(0.3)


def test_guarded_logarithm(spark):
    got = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(P.safe_ln("p").alias("x")).collect()
    assert [g.x for g in got] == [-P.LARGEST_DOUBLE, 0.0, None]


def test_priors_integrate_to_one():
    xs = np.linspace(1e-4, 60, 400_000)
    for name, inside in (("gamma", xs), ("var_log_nu", xs)):
        assert np.trapezoid([math.exp(params.ln_prior_of(name, x)) for x in inside[::20]], inside[::20]) == pytest.approx(1, abs=0.01)


def brute_conditionals(t, state, alpha, nu):
    p, out = t.matrices(alpha, nu), {}
    for v in np.flatnonzero(~t.leaf):
        w = []
        for s in (0, 1):
            x = math.log([1 - alpha, alpha][s]) if t.parent[v] < 0 else math.log(p[t.bins[v], state[t.parent[v]], s])
            w.append(x + sum(math.log(p[t.bins[c], s, state[c]]) for c in np.flatnonzero(t.parent == v)))
        out[v] = w
    return out


def arrays():
    parent = np.array([-1, 0, 0, 1, 1, 2, 2, -1, 7])
    depth = np.array([0, 1, 1, 2, 2, 2, 2, 0, 1])
    return field.TreeArrays(parent, np.array([0, 3, 9, 1, 2, 15, 4, 0, 6]), np.isin(np.arange(9), [3, 4, 5, 6, 8]), tuple(np.flatnonzero(depth == d) for d in range(3)), 20)


def test_gibbs_has_the_exact_marginals():
    t, alpha, nu = arrays(), 0.3, 0.8
    leaves = {3: 1, 4: 1, 5: 0, 6: 1, 8: 0}
    inner = [0, 1, 2, 7]
    p = t.matrices(alpha, nu)
    weight = {}
    for bits in itertools.product((0, 1), repeat=4):
        s = np.zeros(9, int)
        s[inner] = bits
        for k, v in leaves.items():
            s[k] = v
        weight[bits] = math.prod([1 - alpha, alpha][s[v]] if t.parent[v] < 0 else p[t.bins[v], s[t.parent[v]], s[v]] for v in range(9))
    exact = np.array([sum(w for b, w in weight.items() if b[k]) for k in range(4)]) / sum(weight.values())
    state = np.zeros(9, int)
    for k, v in leaves.items():
        state[k] = v
    total, n = np.zeros(4), 6000
    for it in range(n):
        state, density = field.gibbs_clique(t, state, alpha, nu, field.clique_uniforms(9, 5, 1, it))
        total += state[inner]
    assert np.allclose(total / n, exact, atol=0.03) and np.isfinite(density)


def test_conditionals_of_spark_and_arrays_agree(spark):
    t, rng = arrays(), np.random.default_rng(3)
    ids = [f"v{i}" for i in range(9)]
    rows = [(ids[i], ids[t.parent[i]] if t.parent[i] >= 0 else None, int(t.bins[i]), "leaf" if t.leaf[i] else "root" if t.parent[i] < 0 else "internal", None if t.parent[i] < 0 else i) for i in range(9)]
    table = spark.createDataFrame(rows, "id string, parent string, bin int, kind string, branch_ix long")
    branches = [i for i in range(9) if t.parent[i] >= 0]
    table = table.drop("branch_ix").join(spark.createDataFrame([(ids[v], k) for k, v in enumerate(branches)], "id string, branch_ix long"), "id", "left")
    table = table.join(spark.createDataFrame([("v0", 0), ("v7", 1)], "id string, root_ix long"), "id", "left")
    cliques = spark.createDataFrame([(0, 0.3, 0.8), (1, 0.6, 2.0)], "clique long, alpha double, nu double")
    st = {k: rng.integers(0, 2, 9) for k in (0, 1)}
    states = spark.createDataFrame([(k, ids[i], bool(s[i])) for k, s in st.items() for i in range(9) if s[i] or i % 2], "clique long, id string, state boolean")
    grid = field.all_branches(states, table, cliques)
    got = {(r.clique, r.id): (r.log0, r.log1) for r in field.full_conditionals(grid, states, table, cliques, 20).collect()}
    for k, (a, v) in enumerate(((0.3, 0.8), (0.6, 2.0))):
        for node, w in brute_conditionals(t, st[k], a, v).items():
            assert got[k, ids[node]] == pytest.approx(tuple(w))
    joint = field.joint_log_density(grid, states, table, cliques, 20).first()[0]
    touched, counts = field.touched_branches(states, table, cliques), field.bulk_counts(table, 20)
    assert touched.count() < grid.count() and field.sparse_joint_log_density(touched, states, table, cliques, counts).first()[0] == pytest.approx(joint)
    whole = {r.clique: (r["cur"], r["try"]) for r in field.tree_log_likelihood(grid, 20, F.lit(0.4), F.col("nu") * 2).collect()}
    assert {r.clique: (r["cur"], r["try"]) for r in field.sparse_log_likelihood(touched, cliques, counts, F.lit(0.4), F.col("nu") * 2).collect()} == {k: pytest.approx(v) for k, v in whole.items()}
    pairs = spark.createDataFrame([("a", "v1", 3, True), ("a", "v2", 9, False), ("b", "v3", 1, True), ("b", "v8", 6, False)], "pair string, id string, bin int, first boolean")
    moves = params.pair_moves(pairs, 20, 1, 1)
    ratios = [{r.pair: r.log_ratio for r in x.collect()} for x in (params.pair_ratios(moves, grid, 20), params.sparse_pair_ratios(moves, touched, cliques, 20))]
    assert ratios[1] == {k: pytest.approx(v) for k, v in ratios[0].items()}
    want = 0.0
    for k, (a, v) in enumerate(((0.3, 0.8), (0.6, 2.0))):
        p = t.matrices(a, v)
        want += sum(math.log([1 - a, a][st[k][i]]) if t.parent[i] < 0 else math.log(p[t.bins[i], st[k][t.parent[i]], st[k][i]]) for i in range(9))
    assert joint == pytest.approx(want)


def test_likelihood_bulk_term_equals_all_cells(spark):
    rng = np.random.default_rng(1)
    y, link = rng.random((6, 7)) < 0.3, rng.random((6, 7)) < 0.2
    er, ec, eps = rng.random(6) * 0.9 + 0.05, rng.random(7) * 0.9 + 0.05, 0.01
    cells = lambda m: [(int(r), int(c)) for r, c in zip(*np.nonzero(m), strict=True)]
    dy = spark.createDataFrame([(r, c, True, 0) for r, c in cells(y)] + [(0, 0, False, 0)] * (not y[0, 0]), "r long, c long, state boolean, n_ones int")
    dl = spark.createDataFrame(cells(link), "r long, c long")
    fr = spark.createDataFrame([(i, float(e)) for i, e in enumerate(er)], "leaf_ix long, effort_r double")
    fc = spark.createDataFrame([(i, float(e)) for i, e in enumerate(ec)], "leaf_ix long, effort_c double")
    got = likelihood.link_log_likelihood(dy, dl, fr, fc, sparse.Shape(6, 7), eps).first()
    e = np.outer(er, ec)
    p = np.where(y, np.where(link, e, 1 - e), np.where(link, eps, 1 - eps))
    assert got.log_likelihood == pytest.approx(np.log(p).sum())
    none = dy.limit(0)
    assert likelihood.link_log_likelihood(none, dl.limit(0), fr, fc, sparse.Shape(6, 7), eps).first().log_likelihood == pytest.approx(42 * math.log(1 - eps))


def test_collapse_errors():
    for keep in ([], ["s", "s", "m"], ["x", "m"], ["s"], ["m", "m"]):
        with pytest.raises(ValueError):
            likelihood.kept_dimensions(["s", "m"], keep)
    assert likelihood.kept_dimensions(["s", "o", "m"], ["s", "m"]) == [0, 2]


def test_cells_by_binomial_numbers(spark):
    rows = field.bernoulli_cells(spark, sparse.Shape(40, 250), 0.1, 5, 100).collect()
    cells = {(r.r, r.c) for r in rows}
    assert len(cells) == len(rows) and all(0 <= r < 40 and 0 <= c < 250 for r, c in cells)
    assert abs(len(cells) - 1000) < 4 * math.sqrt(900) and max(c for _, c in cells) > 240


@pytest.mark.parametrize("use_links", [True, False])
def test_the_sparse_sweep_has_the_same_probabilities(spark, use_links):
    rng = np.random.default_rng(8)
    n_r, n_c, n_bins = 60, 80, 4
    rows = spark.createDataFrame([(r, r % 7, int(rng.integers(n_bins)), float(rng.random()), 0.1 + 0.8 * float(rng.random()), 3 * float(rng.random())) for r in range(n_r)], "r long, up_r long, bin_r int, effort_r double, alpha_m double, nu_m double")
    cols = spark.createDataFrame([(c, c % 9, int(rng.integers(n_bins)), float(rng.random()), 0.1 + 0.8 * float(rng.random()), 3 * float(rng.random())) for c in range(n_c)], "c long, up_c long, bin_c int, effort_c double, alpha_s double, nu_s double")
    z_r = spark.createDataFrame([(k % 7, c, c % 5 == 0) for k, c in enumerate(range(0, n_c, 2))], "internal_ix long, other_ix long, state boolean")
    z_c = spark.createDataFrame([(1, 2, True), (8, 30, True)], "internal_ix long, other_ix long, state boolean")
    links = spark.createDataFrame([(r, (7 * r) % n_c) for r in range(0, n_r, 3)], "r long, c long")
    y = spark.createDataFrame([(0, 0, True, 2), (3, 3, False, 1), (7, 8, True, 0)], "r long, c long, state boolean, n_ones int")
    f = field.Field(sparse.Shape(n_r, n_c), n_bins, rows, cols, z_r, z_c, links, 0.01, use_links)
    w = field.y_log_weights(f, field.all_cells(spark, f.shape)).collect()
    p = {(r.r, r.c): 1 / (1 + math.exp(min(700, r.log0 - r.log1))) for r in w}
    special = {(r.r, r.c) for r in field.special_cells(f, y).collect()}
    n, seen = 6, {}
    draws = [field.sparsely_swept_y(spark, f, y, 3, it).select("r", "c", "state", "n_ones") for it in range(n)]
    for r in [r for d in draws for r in d.collect()]:
        assert r.state or (r.r, r.c) in {(0, 0), (3, 3), (7, 8)}
        seen[r.r, r.c] = seen.get((r.r, r.c), 0) + r.state
    assert 100 < len(special) < 1000 and max(seen.values()) <= n
    for cells in (special, set(p) - special):
        spread = math.sqrt(n * sum(p[k] * (1 - p[k]) for k in cells))
        assert abs(sum(seen.get(k, 0) - n * p[k] for k in cells)) < 3.5 * spread
        # weighted by the probabilities themselves, which shows a wrong shape and not only a wrong number
        wrong = sum((seen.get(k, 0) - n * p[k]) * p[k] for k in cells)
        assert abs(wrong) < 3.5 * math.sqrt(n * sum(p[k] ** 3 * (1 - p[k]) for k in cells))
    again = field.sparsely_swept_y(spark, f, y, 3, 0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, draws[0].collect()))


# ---- spectra -----------------------------------------------------------------------------------------------------------------------------------------
# fixed values: a small run whose candidates overlap, and the bounds of packed candidates
def run():
    lists = {0: {10: 100, 20: 120}, 1: {10: 90, 20: 80, 30: 70}, 2: {20: 60, 30: 50}}
    return msms.Run(lists, np.array([50, 60, 70]), np.full(3, -1), np.array([50, 60, 70]))


def test_moves_keep_molecules_apart_and_can_be_undone():
    r, rng = run(), np.random.default_rng(42)
    kinds = set()
    for _ in range(3000):
        u = rng.random(4)
        move = r.propose(u)
        if move is None:
            continue
        kinds.add(int(u[0] * 4))
        before = (r.molecule.copy(), r.bins.copy(), set(r.taken))
        r.apply(r.apply(move[0]))
        assert (r.molecule == before[0]).all() and (r.bins == before[1]).all() and r.taken == before[2]
        r.apply(move[0])
        real = r.molecule[r.molecule >= 0]
        assert len(set(real)) == len(real) and set(real) == r.taken
        for f, m in enumerate(r.molecule):
            assert m < 0 or r.candidates[f][m] == r.bins[f]
    assert kinds == {0, 1, 2, 3}
    assert msms.Run({}, np.array([5]), np.array([-1]), np.array([5])).propose(np.array([0.3, 0.1, 0.1, 0.1])) is None


def test_chain_of_moves_has_the_exact_distribution():
    y, passes, cont = {10, 30}, {10: 0.6, 20: 0.3, 30: 0.5}, 0.05
    r, rng = run(), np.random.default_rng(1)
    seen = {}
    for _ in range(60_000):
        u = rng.random(4)
        move = r.propose(u)
        if move and math.log(u[3]) < r.log_ratio(move[0], y, passes, cont) + move[1]:
            r.apply(move[0])
        seen[tuple(r.molecule)] = seen.get(tuple(r.molecule), 0) + 1
    weight = {}
    for a in itertools.product((-1, 10, 20), (-1, 10, 20, 30), (-1, 20, 30)):
        real = [m for m in a if m >= 0]
        if len(set(real)) == len(real):
            bins = [run().candidates[f].get(m, int(run().unknown[f])) for f, m in enumerate(a)]
            w = math.prod(1 - 1.1 ** (-b / 10) for b in bins)
            for m in (10, 20, 30):
                f = passes[m]
                w *= (f if m in real else 1 - f) if m in y else (cont if m in real else 1 - cont)
            weight[a] = w
    total = sum(weight.values())
    for a, w in weight.items():
        assert abs(seen.get(a, 0) / 60_000 - w / total) < 0.02


def test_pack(spark):
    rows = spark.createDataFrame([(16777214, 125), (0, 200), (None, 128)], "m long, b int")
    m, b = P.unpack(P.pack("m", "b"))
    assert [tuple(r) for r in rows.select(m, b).collect()] == [(16777214, 125), (0, 200), (None, 128)]


# ---- matching -----------------------------------------------------------------------------------------------------------------------------------------
def best_total(edges):
    features = sorted({f for f, _, _ in edges})

    def go(k, used):
        if k == len(features):
            return 0.0
        return max([go(k + 1, used), *(s + go(k + 1, used | {m}) for f, m, s in edges if f == features[k] and m not in used)])

    return go(0, frozenset())


@pytest.mark.parametrize("most", [1000, 0])
def test_matching_against_all_choices(spark, most):
    rng = np.random.default_rng(5)
    edges = list({(f"f{rng.integers(6)}{b}", f"m{rng.integers(5)}{b}"): 0 for b in "ab" for _ in range(14)})
    edges = [(f, m, float(round(rng.random() + 0.01, 6))) for f, m in edges]
    got = matching.assign(spark.createDataFrame(edges, "feature string, molecule string, score double"), 0.3, most, 1e-3).collect()
    taken = [r.Assigned_Molecule for r in got if not r.Unassigned]
    assert len(set(taken)) == len(taken) and len(got) == len({f for f, _, _ in edges})
    slack = 0.0 if most else 1e-3 * len(got)
    assert sum(best_total([e for e in edges if e[0][-1] == b]) for b in "ab") - sum(r.Score for r in got) <= slack + 1e-5
    summary = matching.assignment_summary(spark.createDataFrame(got)).first()
    assert summary.n_assigned == len(taken) and summary.n_features == len(got)


def test_both_ways_of_matching_give_the_largest_total(spark):
    rng = np.random.default_rng(2)
    edges = [(f"f{i}", f"m{j}", 0.5 + int(rng.integers(60)) * 1e-5) for i in range(5) for j in range(4) if rng.random() < 0.8]
    df = spark.createDataFrame(edges, "feature string, molecule string, score double")
    totals = [sum(r.Score for r in matching.assign(df, 0.3, most, 1e-3).collect()) for most in (1000, 0)]
    assert totals == pytest.approx([best_total(edges)] * 2, abs=5e-7)


def test_an_auction_that_runs_out_of_rounds_fails(spark):
    edges = spark.createDataFrame([(f, "m", 1.0) for f in "abc"], "feature string, molecule string, score double")
    with pytest.raises(RuntimeError):
        matching.auction(matching.Cuts(spark, "test"), edges, 1e-3, 2)


def test_edges_under_other_names(spark):
    df = spark.createDataFrame([("a", "x", "0.5"), ("a", "y", "oops"), ("b", None, "1"), ("b", "z", "-1"), ("b", "w", None)], "`Feat ` string, Compound string, Prob string")
    assert [tuple(r) for r in matching.read_edges(df).collect()] == [("a", "x", 0.5)]
    with pytest.raises(ValueError):
        matching.read_edges(df.drop("Prob"))
    assert matching.assign(matching.read_edges(df).limit(0)).count() == 0


# ---- the two tasks ----------------------------------------------------------------------------------------------------------------------------------------
def small_world(spark):
    sp = synthetic.balanced(spark, "s", 15)
    mo = synthetic.balanced(spark, "m", 15)
    papers = [spark.createDataFrame([(f"{x}_{i}", 40, 0) for i in range(7, 15)], "leaf string, n long, ord long") for x in "sm"]
    return sp, mo, papers


def test_simulate_then_infer(spark):
    sp, mo, (pr, pc) = small_world(spark)
    config = engine.Config(iterations=4, n_burnin=1, burnin=2, seed=3, log_nu_mean=-1.0, gamma=0.4, update_parameters=False)
    made = engine.simulate(spark, config, sp, mo, pr, pc, iterations=1)
    truth = {(r.r, r.c) for r in made["y"].collect()}
    links = made["links"]
    names = links.select(F.concat(F.lit("s_"), F.col("r") + 7).alias("species"), F.concat(F.lit("m_"), F.col("c") + 7).alias("molecules"))
    events = []
    got = engine.infer(spark, config, sp, mo, names, pr, pc, lambda event, _: events.append(event))
    y = {(r.r, r.c): r.fraction for r in got["y"].collect()}
    assert events == ["start", "burnin", "end"]
    assert all(0 < f <= 1 for f in y.values())
    cells = [(i, j) for i in range(8) for j in range(8)]
    right = np.mean([(y.get(c, 0) > 0.5) == (c in truth) for c in cells])
    assert right > 0.7
    again = engine.infer(spark, config, sp, mo, names, pr, pc, lambda *_: None)
    assert {(r.r, r.c): r.fraction for r in again["y"].collect()} == y


def test_hyper_parameters_have_the_exact_posterior():
    x = np.array([0.3, -0.2, 0.9, 0.4])
    moments = (len(x), x.sum(), (x * x).sum())
    rng = np.random.default_rng(4)
    mean, var, seen = 0.0, 1.0, []
    for _ in range(40_000):
        mean, var = params.updated_hyper(moments, mean, var, (0.8, 0.5), rng)
        seen.append((mean, var))
    ms, vs = np.meshgrid(np.linspace(-4, 4, 400), np.linspace(0.005, 8, 800), indexing="ij")
    ln = -0.5 * len(x) * np.log(2 * np.pi * vs) - ((x[:, None, None] - ms) ** 2).sum(0) / (2 * vs) - ms**2 / 4 - vs
    w = np.exp(ln - ln.max())
    assert np.allclose(np.mean(seen, 0), [(w * ms).sum() / w.sum(), (w * vs).sum() / w.sum()], atol=0.04)


def test_pairs_leave_one_branch_out_at_most(spark):
    for n in (100, 101):
        rows = spark.range(n).select(F.concat(F.lit("b"), "id").alias("id"), (F.col("id") % 20).cast("int").alias("bin"))
        pairs = params.branch_pairs(rows, 3, 1)
        assert pairs.count() == n - n % 2 and pairs.select("id").distinct().count() == n - n % 2
        moves = params.pair_moves(pairs, 20, 3, 1).collect()
        assert len(moves) == n // 2 and all(0 <= r.bin_1 + r.move <= 19 and 0 <= r.bin_2 - r.move <= 19 for r in moves)


def test_one_iteration_with_parameters(spark):
    sp, mo, (pr, pc) = small_world(spark)
    names = spark.createDataFrame([("s_7", "m_7"), ("s_8", "m_7"), ("s_9", "m_14")], "species string, molecules string")
    runs = spark.createDataFrame([(1, 0, 1), (2, 1, 1)], "run long, species long, filter long")
    cands = spark.createDataFrame([(1, 1, 0, 200), (1, 1, 1, 180), (1, 2, 1, 150), (2, 1, 0, 220)], "run long, feature long, molecule long, bin int")
    unknowns = spark.createDataFrame([(1, 1, 20), (1, 2, 20), (2, 1, 20)], "run long, feature long, bin int")
    config = engine.Config(iterations=2, n_burnin=0, seed=1, trace_states=True)
    start_y, start_z = spark.createDataFrame([(0,), (9,)], "position long"), {"species": spark.createDataFrame([(0,), (8,)], "position long")}
    got = engine.infer(spark, config, sp, mo, names, pr, pc, lambda *_: None, start_y, start_z, engine.Spectra(runs, cands, unknowns))
    summary = {r.name: r for r in got["summary"].collect()}
    plain = {"gamma_species", "gamma_molecules", "epsilon", "pseudo_log_density", "contamination", *(f"{t}_{k}" for t in ("species", "molecules") for k in ("mean_log_nu", "var_log_nu"))}
    cliques = {f"{t}_{k}_{o}_{i}" for t, o in (("species", "m"), ("molecules", "s")) for k in ("alpha", "log_nu") for i in range(7, 15)}
    branches = {f"{t}_branch_lengths_{t[0]}_{i}" for t in ("species", "molecules") for i in range(1, 15)}
    assert set(summary) == plain | cliques | branches and all(r.n == 2 for r in summary.values())
    assert sum(summary[f"species_branch_lengths_s_{i}"].post_mean for i in range(1, 15)) == 14 * 20 // 2
    assert got["assigned"].count() == 3 and msms.molecules_twice(got["assigned"]).count() == 0
    assert {r["index"] for r in got["filters"].collect()} <= set(range(1, 255)) and got["filters"].count() == 2
    assert {r.iteration for r in got["y_trace"].collect()} <= {1, 2} and got["z_species_trace"].where("position >= 7 * 8").count() == 0
    truth = spark.createDataFrame([("species_alpha_m_7", 0.5), ("nothing", 1.0)], "name string, value double")
    assert analysis.true_against_inferred(truth, got["summary"]).count() == 1
    with pytest.raises(sparse.OutOfBounds):
        engine.infer(spark, config, sp, mo, names, pr, pc, lambda *_: None, spark.createDataFrame([(64,)], "position long"))
    with pytest.raises(ValueError):
        engine.infer(spark, config, sp, mo, names, pr, pc, lambda *_: None, spectra=engine.Spectra(runs, cands, unknowns.limit(1)))
    with pytest.raises(ValueError):
        engine.infer(spark, engine.Config(iterations=1), sp, mo, spark.createDataFrame([("s_0", "m_7")], "species string, molecules string"), pr, pc)
    for bad in ({"n_bins": 255}, {"epsilon": 0.0}):
        with pytest.raises(ValueError):
            engine.Config(**bad)

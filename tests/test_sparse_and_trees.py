import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions.prob import delta, lattice
from cladewise.operators import sparse, trees
from cladewise.sources import synthetic, writers

M = "r long, c long, state boolean, n_ones int"


def matrix(spark, cells):
    return spark.createDataFrame([(r, c, s, n) for (r, c), (s, n) in cells.items()], M)


def test_small_matrix(spark):
    shape = sparse.Shape(2, 3)
    m = sparse.insert(matrix(spark, {}), spark.createDataFrame([(1, 2)], "r long, c long"), True, shape)
    assert [r.state for r in sparse.densified(spark, m, shape).orderBy("linear").collect()] == [False] * 5 + [True]
    m = sparse.set_states(m, spark.createDataFrame([(1, 2, False)], "r long, c long, state boolean"))
    assert m.count() == 1 and not any(r.state for r in sparse.densified(spark, m, shape).collect())
    with pytest.raises(sparse.OutOfBounds):
        sparse.insert(m, spark.createDataFrame([(2, 1)], "r long, c long"), True, shape)
    assert sparse.without_zeros(m).count() == 0


def test_counts_survive_flips(spark):
    shape = sparse.Shape(10, 10, 1000)
    m = matrix(spark, {(0, 3): (True, 0), (5, 5): (False, 0)})
    for k in range(1, 5):
        m = sparse.counted(m, k, shape)
    got = {(r.r, r.c): (r.n_ones, r.fraction) for r in sparse.fraction_of_ones(m, 1000).collect()}
    assert got == {(0, 3): (4, 0.004), (5, 5): (0, 0.0)}
    flipped = sparse.set_states(m, spark.createDataFrame([(0, 3, False)], "r long, c long, state boolean"))
    assert {(r.r, r.c): (r.state, r.n_ones) for r in flipped.collect()}[0, 3] == (False, 4)
    assert {r.n_ones for r in sparse.without_counts(flipped).collect()} == {0}
    assert sparse.Shape(1, 1, 100_000).thinning == 4


def test_windows_equal_point_lookups(spark):
    rng = np.random.default_rng(42)
    for density in (0.001, 0.05, 0.5):
        x, kept = rng.random((40, 40)) < density, rng.random((40, 40)) < 0.1
        cells = {(int(r), int(c)): (bool(x[r, c]), 0) for r, c in zip(*np.nonzero(x | kept), strict=True)}
        m, shape = matrix(spark, cells).cache(), sparse.Shape(40, 40)
        for at in (0, 17, 39):
            row = sparse.row_window(spark, m, shape, at, 5, 100).orderBy("linear").collect()
            assert [(r.linear, r.c, r.state, r.exists) for r in row] == [(at * 40 + c, c, bool(x[at, c]), (at, c) in cells) for c in range(5, 40)]
            col = sparse.column_window(spark, m, shape, at, 0, 7).orderBy("linear").collect()
            assert [(r.linear, r.r, r.state) for r in col] == [(r * 40 + at, r, bool(x[r, at])) for r in range(7)]


def test_duplicates_and_dump(spark):
    m = matrix(spark, {(0, 1): (True, 2)})
    assert sparse.duplicate_cells(m.unionByName(m)).count() == 1
    names = spark.createDataFrame([(0, "a"), (1, "b")], "ix long, id string")
    full = writers.y_dump(spark, m, sparse.Shape(2, 2), names, names, 4, True).collect()
    assert [(r.position, r.Y_state, r.species, r.molecules, r.fraction_of_one) for r in full] == [(0, 0, "a", "a", 0.0), (1, 1, "a", "b", 0.5), (2, 0, "b", "a", 0.0), (3, 0, "b", "b", 0.0)]
    assert writers.wide_trace(writers.trace_rows(m, sparse.Shape(2, 2), 7), [0, 1]).collect()[0].asDict() == {"iteration": 7, "p0": 0, "p1": 1}


E = "child string, parent string, length double, ord long"


def test_order_follows_the_rows(spark):
    # the parent of a row comes before its child; a root may become a child later
    rows = [("b", "a", 1.0, 0), ("c", "a", 2.0, 1), ("a", "top", 1.0, 2), ("y", "x", 3.0, 3)]
    got = {r.id: r for r in trees.nodes(spark.createDataFrame(rows, E)).collect()}
    assert sorted(got, key=lambda k: got[k].node_ix) == ["a", "b", "c", "top", "x", "y"]
    assert {k: r.kind for k, r in got.items()} == {"a": "internal", "b": "leaf", "c": "leaf", "top": "root", "x": "root", "y": "leaf"}
    assert [got[k].leaf_ix for k in "bcy"] == [0, 1, 2] and [got[k].internal_ix for k in ("a", "top", "x")] == [0, 1, 2]
    assert [got[k].root_ix for k in ("top", "x")] == [0, 1] and [got[k].branch_ix for k in "abcy"] == [0, 1, 2, 3] and got["top"].branch_ix is None


def test_bad_edges(spark):
    rows = [("a", "a", 1.0, 0), ("b", "a", 0.0, 1), ("b", "c", float("nan"), 2), (None, "c", 1.0, 3)]
    found = {(r.problem, r.child): r.n for r in trees.edge_problems(spark.createDataFrame(rows, E)).collect()}
    assert found == {("self_loop", "a"): 1, ("bad_length", "b"): 2, ("no_name", None): 1, ("second_parent", "b"): 2}
    with pytest.raises(trees.InvalidForest, match="bad_length: b"):
        trees.validated(spark.createDataFrame(rows, E))


def test_bins_are_the_first_point_not_below(spark):
    n, d = 20, delta(20)
    grid = [d * k for k in range(n)]
    rng = np.random.default_rng(0)
    xs = [*grid, *(rng.random(500) * 2.5), 0.0, 9.0, *(np.nextafter(g, 9) for g in grid)]
    got = spark.createDataFrame([(float(x),) for x in xs], "length double").withColumn("bin", trees.bin_of(F.col("length"), n)).collect()
    for r in got:
        assert r.bin == min(next((k for k in range(n) if grid[k] >= r.length), n - 1), n - 1)


@pytest.mark.parametrize("bins", [[0] * 10, [19] * 7, [0, 19, 19, 19, 18], [9, 10, 10, 11], [3], list(range(20))])
def test_repair_reaches_the_sum(spark, bins):
    df = spark.createDataFrame([(f"n{i}", b) for i, b in enumerate(bins)], "id string, bin int")
    got = [r.bin for r in trees.repaired_bins(df, 20, 3).collect()]
    assert sum(got) == len(bins) * 20 // 2 and all(0 <= b < 20 for b in got)


def test_generators(spark):
    assert synthetic.grass(spark, "g", 6).count() == 3 and synthetic.star(spark, "s", 5).count() == 4
    t = trees.nodes(synthetic.balanced(spark, "b", 7))
    assert trees.node_counts(t).first().asDict() == {"n_nodes": 7, "n_leaves": 4, "n_internals": 3, "n_roots": 1, "n_branches": 6}
    for make, n in ((synthetic.grass, 3), (synthetic.star, 2), (synthetic.balanced, 6)):
        with pytest.raises(ValueError):
            make(spark, "x", n)


def test_cliques_of_three_trees(spark):
    two, three = trees.nodes(synthetic.star(spark, "a", 3)), trees.nodes(synthetic.star(spark, "b", 4))
    got = sorted((r.clique_ix, r.name) for r in trees.cliques(two, [two, three]).collect())
    assert [g[0] for g in got] == list(range(6)) and got[1][1] == "a_2_b_1"
    assert trees.clique_stride([4, 5, 6], 0) == 30 and trees.clique_stride([4, 5, 6], 2) == 1


def test_poisson_and_lattice(spark):
    counts = spark.range(4000).select(synthetic.poisson(lattice("id", F.lit(3)), 4.0).alias("n")).toPandas()["n"]
    assert abs(counts.mean() - 4) < 0.15 and abs(counts.var() - 4) < 0.5


def test_dense_index_over_blocks(spark):
    df = spark.createDataFrame([(i * i * 37 % 1009, "ab"[i % 2]) for i in range(200)], "o long, g string").dropDuplicates(["o"])
    rows = trees.dense_index(df, "o", "ix", ("g",), block=50).collect()
    for g in "ab":
        own = sorted((r.o, r.ix) for r in rows if r.g == g)
        assert [ix for _, ix in own] == list(range(len(own)))

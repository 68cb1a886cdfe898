"""Sweeps that count ones by kinds of columns against cells that are joined one by one, and what they move."""

import dataclasses

import numpy as np
import pytest
from compare import DATA, compare
from pyspark.sql import functions as F

from cladewise.functions.prob import lattice
from cladewise.operators import field, sparse
from cladewise.plans import field_queries as fq
from cladewise.plans import registry


@pytest.fixture(scope="module")
def world(spark):
    rng, shape = np.random.default_rng(5), sparse.Shape(90, 70)

    def leaves(n, names):
        rows = [(i, int(rng.integers(4)), int(rng.integers(20)) % 3, float(rng.choice([0.0, 0.9, 1.0])), float(rng.choice([0.2, 0.5, 1.0])), float(rng.choice([0.3, 30.0]))) for i in range(n)]
        return spark.createDataFrame(rows, f"{names[0]} long, {names[1]} long, {names[2]} int, {names[3]} double, {names[4]} double, {names[5]} double")

    def ones(n_a, n_b, p, names):
        cells = [(int(a), int(b), bool(rng.random() < 0.7)) for a, b in zip(*np.nonzero(rng.random((n_a, n_b)) < p), strict=True)]
        return spark.createDataFrame(cells, f"{names[0]} long, {names[1]} long, state boolean")

    rows, cols = leaves(90, ("r", "up_r", "bin_r", "effort_r", "alpha_m", "nu_m")), leaves(70, ("c", "up_c", "bin_c", "effort_c", "alpha_s", "nu_s"))
    z = ("internal_ix", "other_ix")
    links = ones(90, 70, 0.2, ("r", "c")).where("state").select("r", "c")
    return shape, rows, cols, ones(4, 70, 0.5, z), ones(4, 90, 0.05, z), links


@pytest.mark.parametrize("use_links", [True, False])
@pytest.mark.parametrize(("kind_cost", "few"), [(0, 10**6), (0, 4), (0, 1), (10**9, 1)])
def test_counts_are_those_of_joined_cells(spark, world, monkeypatch, use_links, kind_cost, few):
    """Counted by kind, with none, some or all of the kinds as improbable ones, and visited cell by cell; whole and in small pieces."""
    shape, rows, cols, z_r, z_c, links = world
    f = field.Field(shape, 20, rows, cols, z_r, z_c, links.unionByName(links), 0.01, use_links)
    y = spark.createDataFrame([], "r long, c long, n_ones int")
    cells = field.swept_y(spark, dataclasses.replace(f, links=links), y, lattice("r", "c", 4)).where("state")
    want = {x.r: x["count"] for x in cells.groupBy("r").count().collect()}
    monkeypatch.setattr(field, "KIND_COST", kind_cost)
    monkeypatch.setattr(field, "FEW", few)
    for pieces in ({}, {"COUNT_ROWS": 10, "COUNT_COLS": 9, "AT_ONCE": 20}):
        for name, value in pieces.items():
            monkeypatch.setattr(field, name, value)
        got = field.swept_counts(spark, f, 4).collect()
        assert len(got) == 90 and {x.r: x.n_ones for x in got if x.n_ones} == want and len(set(want.values())) > 5
    with pytest.raises(ValueError):
        field.swept_counts(spark, dataclasses.replace(f, seen=lambda cells: cells))


def test_grid_of_more_cells_than_an_int_counts(spark):
    """Rows with and without links, cell by cell in arrays."""
    n_r, n_c, eps = 50_000, 60_000, 0.01
    c, linked = np.arange(n_c), {r: (np.arange(r % 7, n_c, 31 + r % 5)) for r in (0, 777, 35_791, 49_999)}
    rows = spark.range(n_r).select(F.col("id").alias("r"), F.lit(0).cast("long").alias("up_r"), (F.col("id") % 3).alias("bin_r"), F.lit(0.9).alias("effort_r"), F.lit(0.3).alias("alpha_m"), F.lit(0.5).alias("nu_m"))
    cols = spark.range(n_c).select(F.col("id").alias("c"), F.lit(0).cast("long").alias("up_c"), F.lit(4).alias("bin_c"), (F.col("id") % 4 / 3.0).alias("effort_c"), F.lit(0.6).alias("alpha_s"), F.lit(1.5).alias("nu_s"))
    links = spark.createDataFrame([(r, int(k)) for r, cs in linked.items() for k in cs], "r long, c long")
    empty = spark.createDataFrame([], "internal_ix long, other_ix long, state boolean")
    got = {x.r: x.n_ones for x in field.swept_counts(spark, field.Field(sparse.Shape(n_r, n_c), 20, rows, cols, empty, empty, links, eps)).where(F.col("r").isin(*linked, 1, 40_000)).collect()}
    for r in (*linked, 1, 40_000):
        link, efforts = np.isin(c, linked.get(r, [])), 0.9 * (c % 4 / 3.0)
        e = [np.exp(-nu * (b + 0.5) * 2.0 / 21) for nu, b in ((1.5, r % 3), (0.5, 4))]
        odds = (0.6 * (1 - e[0]) * 0.3 * (1 - e[1])) / ((0.4 + 0.6 * e[0]) * (0.7 + 0.3 * e[1])) * np.where(link, efforts / eps, (1 - efforts) / (1 - eps))
        assert got[r] == np.sum(((r * 7919 + c * 104729) % 1000003 + 0.5) / 1000003.0 < odds / (1 + odds)) > 0


def test_thresholds_are_those_of_single_numbers():
    rng = np.random.default_rng(1)
    log0, log1 = np.r_[rng.normal(0, 3, 40), 0.0, 0.0, -np.inf, -np.inf, -1.797e308], np.r_[rng.normal(0, 3, 40), 0.0, -np.inf, 0.0, -np.inf, -0.1]
    u = (np.arange(1000003) + 0.5) / 1000003.0
    with np.errstate(over="ignore", invalid="ignore"):
        want = [int((~(u >= 1 / (1 + np.exp(a - b)))).sum()) for a, b in zip(log0, log1, strict=True)]
    assert field._thresholds(log0, log1).tolist() == want


@pytest.mark.parametrize("name", ["sv_g18_simulated_y", "sv_g02_g04_sweep"])
def test_a_sweep_moves_every_leaf_once(spark, monkeypatch, name):
    """However many columns there are: the rows of a block were sent to each block of columns before."""
    sent, tables = [], field._counting_tables
    monkeypatch.setattr(field, "_counting_tables", lambda *x: sent.append(tables(*x)) or sent[-1])
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], DATA) > 0
    rows, cells = sent[0]
    lines = fq.raw(spark, DATA, "lineitem").count()
    assert rows.count() == rows.select("r").distinct().count() == fq.raw(spark, DATA, "customer").count() and cells.count() <= lines
    assert cells.where(F.col("what").isin(1, 2, 3)).count() == cells.count()

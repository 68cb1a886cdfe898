"""Sweeps over the full grid inside of its blocks against cells that are joined one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions.prob import lattice, p_link
from cladewise.operators import field, sparse


@pytest.fixture(scope="module")
def world(spark):
    rng, shape = np.random.default_rng(8), sparse.Shape(37, 29)

    def leaves(n, names):
        rows = [(i, int(rng.integers(5)), int(rng.integers(20)), float(rng.random()), float(rng.random() * 0.8 + 0.1), float(rng.choice([0.3, 2.0, 30.0]))) for i in range(n)]
        return spark.createDataFrame(rows, f"{names[0]} long, {names[1]} long, {names[2]} int, {names[3]} double, {names[4]} double, {names[5]} double")

    def ones(n_a, n_b, p, names, state=True):
        cells = [(int(a), int(b), bool(state or rng.random() < 0.5)) for a, b in zip(*np.nonzero(rng.random((n_a, n_b)) < p), strict=True)]
        return spark.createDataFrame(cells, f"{names[0]} long, {names[1]} long, state boolean")

    rows, cols = leaves(37, ("r", "up_r", "bin_r", "effort_r", "alpha_m", "nu_m")), leaves(29, ("c", "up_c", "bin_c", "effort_c", "alpha_s", "nu_s"))
    z = ("internal_ix", "other_ix")
    y = ones(37, 29, 0.1, ("r", "c"), False).withColumn("n_ones", F.lit(2))
    return shape, rows, cols, ones(5, 29, 0.4, z, False), ones(5, 37, 0.4, z, False), ones(37, 29, 0.1, ("r", "c")).drop("state"), y


@pytest.mark.parametrize("use_links", [True, False])
def test_blocks_draw_what_joined_cells_draw(spark, world, monkeypatch, use_links):
    shape, rows, cols, z_r, z_c, links, y = world
    f = field.Field(shape, 20, rows, cols, z_r, z_c, links, 0.01, use_links)
    want = {(x.r, x.c): x.state for x in field.swept_y(spark, f, y, lattice("r", "c", 4)).collect()}
    for name, value in (("BLOCK_ROWS", 10), ("BLOCK_COLS", 7), ("AT_ONCE", 20)):
        monkeypatch.setattr(field, name, value)
    swept = field.swept_rows(f, y, field.lattice_cells(4)).collect()
    got = [((x.r, c), s) for x in swept for s, cs in ((True, x.ones), (False, x.zeros)) for c in cs]
    assert len(got) == len(want) and dict(got) == want and 0 < sum(want.values()) < len(want)
    with pytest.raises(ValueError):
        field.swept_rows(field.Field(shape, 20, rows, cols, z_r, z_c, links, 0.01, True, lambda cells: cells), y, field.lattice_cells())


def test_blocks_move_no_row_per_cell(spark, world):
    """A grid of 10^10 cells with a few leaves in it: the cells between them aren't made."""
    _, rows, cols, z_r, z_c, links, y = world
    f = field.Field(sparse.Shape(10**5, 10**5), 20, rows, cols, z_r, z_c, links, 0.01)
    assert sum(len(x.ones) for x in field.swept_rows(f, y, field.lattice_cells()).collect()) > 0


def test_links_are_those_of_joined_cells(spark, world):
    shape, rows, cols, _, _, _, y = world
    u = lattice("r", "c", 3)
    cells = field.all_cells(spark, shape).join(y.where("state").select("r", "c", F.lit(True).alias("x")), ["r", "c"], "left").fillna({"x": False}).join(rows, "r").join(cols, "c")
    want = {(x.r, x.c) for x in cells.where(u < p_link("x", F.lit(True), F.col("effort_r") * F.col("effort_c"), 0.2)).collect()}
    drawn = field.drawn_links(spark, shape, y, rows, cols, 0.2, u).collect()
    assert len(drawn) == len(want) > 0 and {(x.r, x.c) for x in drawn} == want
    assert field.drawn_links(spark, sparse.Shape(2000, 20000), y, rows, cols, 0.2, u).count() == len(want)

"""The full grid in runs of equal cells: as many rows as stored cells ask for, and the cells of the grid when they are made."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.operators import sparse
from cladewise.sources import writers


@pytest.mark.parametrize(("part", "piece"), [(2**20, 2**13), (7, 3)])
def test_runs_are_the_grid(spark, monkeypatch, part, piece):
    monkeypatch.setattr(sparse, "PART", part)
    monkeypatch.setattr(sparse, "PIECE", piece)
    rng, shape = np.random.default_rng(3), sparse.Shape(6, 23)
    cells = {(int(r), int(c)): (bool(rng.random() < 0.5), int(rng.integers(5))) for r, c in zip(*np.nonzero(rng.random((6, 23)) < 0.2), strict=True) if r != 2}
    m = spark.createDataFrame([(r, c, s, n) for (r, c), (s, n) in cells.items()], "r long, c long, state boolean, n_ones int")
    runs = sparse.dense_runs(spark, m, shape)
    got = {(x.r, x.c): (x.state, x.exists, x.n_ones) for x in sparse.cells_of_runs(runs).collect()}
    want = {(r, c): (cells[r, c][0], True, cells[r, c][1]) if (r, c) in cells else (False, False, 0) for r in range(6) for c in range(23)}
    assert got == want and runs.agg(F.sum("n")).first()[0] == shape.size
    for first, last in ((0, None), (30, 31), (20, 77), (137, 138), (40, 40)):
        block = sparse.densified(spark, m, shape, first, last).collect()
        assert sorted((x.linear, x.r, x.c, x.state, x.exists) for x in block) == [(r * 23 + c, r, c, *want[r, c][:2]) for r in range(6) for c in range(23) if first <= r * 23 + c < (138 if last is None else last)]


def test_sums_by_row_need_no_row_per_cell(spark):
    """A grid of 3 x 10^12 cells, of which three are stored."""
    shape = sparse.Shape(3, 10**12)
    m = spark.createDataFrame([(1, 5, True, 4), (1, 10**12 - 1, False, 2), (2, 2**21, True, 0)], "r long, c long, state boolean, n_ones int")
    names = spark.createDataFrame([(r, f"s{r}") for r in range(3)], "ix long, id string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sparse, "PART", 2**40)
        got = {x.species: (x.n_cells, x.first, x["last"], x.n_ones, x.fractions) for x in writers.y_dump_by_row(spark, m, shape, names, 8).collect()}
    n = 10**12
    assert got == {"s0": (n, 0, n - 1, 0, 0.0), "s1": (n, n, 2 * n - 1, 1, 0.75), "s2": (n, 2 * n, 3 * n - 1, 1, 0.0)}

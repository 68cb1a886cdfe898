"""The exact matching in arrays against all choices, the solver of small components, and at a size that needs it."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from cladewise.operators import matching


def world(rng, n, m, k, digits):
    edges = {(f"f{rng.integers(n):06d}", f"m{rng.integers(m):06d}"): round(float(rng.random()) + 10.0**-digits, digits) for _ in range(k)}
    return pd.DataFrame([(f, x, s) for (f, x), s in edges.items()], columns=["feature", "molecule", "score"])


@pytest.mark.parametrize("digits", [1, 6])
@pytest.mark.parametrize("rounds", [0, 2, 3000])
def test_arrays_have_the_total_of_small_components(monkeypatch, digits, rounds):
    monkeypatch.setattr(matching, "BID_ROUNDS", rounds)
    rng = np.random.default_rng(digits)
    for n, m, k in ((1, 1, 1), (5, 3, 12), (3, 8, 15), (30, 20, 90), (60, 40, 600), (200, 200, 700)):
        edges = world(rng, n, m, k, digits)
        got = matching.solve_packed(pa.Table.from_pandas(edges)).to_pandas()
        want = matching.solve_component(edges)
        assert got.score.sum() == pytest.approx(want.score.sum(), abs=1e-9) and sorted(got.feature) == sorted(want.feature)
        real = got[got.molecule.notna()]
        assert real.molecule.is_unique and real.merge(edges).shape[0] == len(real) and (got[got.molecule.isna()].score == 0).all()


def test_many_edges_are_matched_at_once(spark):
    edges = world(np.random.default_rng(4), 40_000, 30_000, 500_000, 6)
    began = time.process_time()
    got = matching.solve_packed(pa.Table.from_pandas(edges)).to_pandas()
    assert time.process_time() - began < 60 and got.molecule.notna().sum() > 29_000


@pytest.mark.parametrize(("most", "packed"), [(1000, 0), (0, 1000), (20, 40), (0, 0)])
def test_all_ways_give_the_largest_total(spark, most, packed):
    rng = np.random.default_rng(6)
    parts = [world(rng, 6, 5, k, 6) for k in (5, 30)]
    edges = pd.concat([p.assign(feature=p.feature + x, molecule=p.molecule + x) for p, x in zip(parts, "ab", strict=True)])
    got = matching.assign(spark.createDataFrame(edges), 0.3, most, 1e-3, packed).toPandas()
    assert got.Score.sum() == pytest.approx(matching.solve_component(edges).score.sum(), abs=2e-6) and len(got) == edges.feature.nunique()


def test_the_summary_counts_what_the_arrays_matched(spark):
    edges = world(np.random.default_rng(7), 50, 30, 400, 6)
    got = matching.assignment_summary(matching.assign(spark.createDataFrame(edges), 0.3, 100)).first()
    want = matching.solve_component(edges)
    assert (got.n_features, got.n_assigned, got.n_unassigned) == (len(want), want.molecule.notna().sum(), want.molecule.isna().sum())
    assert got.total_score == pytest.approx(want.score.sum(), abs=1e-4)


def test_few_and_many_edges_go_to_one_task_as_numbers(spark, monkeypatch):
    edges = world(np.random.default_rng(8), 60, 40, 500, 6)
    monkeypatch.setattr(matching, "components", None)
    got = matching.assign(spark.createDataFrame(edges)).toPandas()
    want = matching.solve_component(edges)
    assert got.Score.sum() == pytest.approx(want.score.sum(), abs=1e-4) and list(got.Feature) == sorted(want.feature)
    real = got[~got.Unassigned].merge(edges, left_on=["Feature", "Assigned_Molecule"], right_on=["feature", "molecule"])
    assert len(real) == (~got.Unassigned).sum() and (real.Score - real.score).abs().max() < 1e-6 and real.molecule.is_unique
    assert matching.MOST_PACKED > 8_000_000


def test_bids_in_parts_are_the_same(monkeypatch):
    edges = world(np.random.default_rng(9), 300, 200, 3000, 6)
    whole = matching.solve_packed(pa.Table.from_pandas(edges))
    monkeypatch.setattr(matching, "AT_ONCE", 50)
    assert matching.solve_packed(pa.Table.from_pandas(edges)).equals(whole)

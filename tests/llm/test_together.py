import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.llm import cooccurrence
from cladewise.llm.cooccurrence import block_plan, items_together, transposed_product

ROWS = "basket string, item string, n long, id long"


def pairs(spark, rows, **kw):
    df = spark.createDataFrame([(b, i, 1, 2) for b, i in rows], ROWS)
    return items_together(df, F.col("basket"), F.col("item"), **kw)


def brute(rows, least, lift):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = Counter(i for s in baskets.values() for i in s)
    both = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return {(a, b, k, n[a], n[b]) for (a, b), k in both.items() if k >= least and k * len(baskets) >= lift * n[a] * n[b]}


@pytest.mark.parametrize(("least", "lift", "tile"), [(2, 1.0, 512), (3, 1.5, 4), (1, 0.0, 2), (4, 3.0, 6)])
def test_against_brute_force(spark, monkeypatch, least, lift, tile):
    monkeypatch.setattr(cooccurrence, "ENTRIES", 50 * tile)
    rnd = random.Random(least)
    rows = [(f"b{rnd.randrange(40)}", f"i{int(rnd.paretovariate(0.6)) % 25}") for _ in range(700)] + [(None, "i1"), ("b1", None), ("b1", "i1"), ("b1", "i1")]
    rows += [("huge", f"i{k}") for k in range(25)]
    got = pairs(spark, rows, min_count=least, min_lift=lift, tile=tile)
    assert {(r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b) for r in got.collect()} == brute(rows, least, lift)


def test_lift_is_count_over_expected(spark):
    rows = [(f"b{k}", i) for k in range(4) for i in "xy"] + [(f"c{k}", "z") for k in range(6)]
    (r,) = pairs(spark, rows, min_count=2, min_lift=2.0).collect()
    assert (r.item_a, r.item_b, r.n_baskets) == ("x", "y", 10) and r.expected == pytest.approx(1.6) and r.lift == pytest.approx(2.5)


def test_empty(spark):
    assert pairs(spark, []).count() == 0
    assert pairs(spark, [("a", "x")]).count() == 0


@pytest.mark.parametrize(("chunk", "dense"), [(7, 64), (10_000, 10**9), (10_000, 0), (7, 0)])
def test_sparse_and_dense_products_are_equal(monkeypatch, chunk, dense):
    monkeypatch.setattr(cooccurrence, "CHUNK", chunk)
    monkeypatch.setattr(cooccurrence, "DENSE", dense)
    rng = np.random.default_rng(1)
    x, y = rng.random((30, 12)) < 0.3, rng.random((30, 12)) < 0.2
    total = np.zeros((12, 12), np.int64)
    for _ in range(2):
        transposed_product(total, *(v for m in (x, y) for v in (np.concatenate([np.flatnonzero(r) for r in m]).astype(np.int16), m.sum(1))))
    assert (total == 2 * x.astype(int).T @ y.astype(int)).all()


def test_blocks_hold_all_octaves():
    plan = block_plan({12: 1, 11: 2, 9: 10, 5: 1000, 4: 3}, 8)
    assert plan == {12: (0, 2), 11: (0, 2), 9: (0, 2), 5: (2, 125), 4: (127, 1)}

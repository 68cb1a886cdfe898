import random

import pytest
from pyspark.sql import functions as F

from cladewise.llm.topn import _bin, thresholds, top_items

EDGES = "g string, item string, score double, slice long"


def brute(rows, n):
    best = {}
    for g, i, s, _ in rows:
        if g is not None and i is not None and s is not None and 0 < s < float("inf"):
            best[g, i] = max(s, best.get((g, i), 0))
    out = {}
    for (g, i), s in best.items():
        out.setdefault(g, []).append((-s, i))
    return {(g, i, -s, k + 1) for g, v in out.items() for k, (s, i) in enumerate(sorted(v)[:n])}


def test_large_and_small_groups_with_ties(spark):
    rnd = random.Random(2)
    odd = [None, float("nan"), float("inf"), 0.0, -1.0]
    rows = [("hot", f"m{rnd.randrange(400)}", rnd.choice([0.5, 0.5, 0.9, rnd.random(), *odd[:2]]), 1) for _ in range(3000)]
    rows += [(f"g{rnd.randrange(60)}", f"m{rnd.randrange(30)}", rnd.choice([0.1, 0.2, rnd.random(), *odd]), 1) for _ in range(800)]
    rows += [(None, "m1", 0.5, 1), ("g1", None, 0.5, 1), ("tied", "b", 1.0, 1), ("tied", "a", 1.0, 1), ("tied", "a", 1.0, 1)] + [("same", f"m{k:04}", 0.25, 1) for k in range(1500)]
    df = spark.createDataFrame(rows, EDGES)
    for large in (0, 100, 10_000):
        got = {tuple(r) for r in top_items(df, "g", "item", "score", 5, large).collect()}
        assert got == brute(rows, 5)


def test_thresholds_are_safe_and_only_for_large_groups(spark):
    rows = [("hot", f"m{k:03}", 1 + k / 7) for k in range(100)] + [("cold", f"m{k:03}", 1.0) for k in range(20)]
    df = spark.createDataFrame(rows, "g string, item string, score double")
    (r,) = thresholds(df, 5, 20).collect()
    kept = df.where((F.col("g") == "hot") & (_bin(F.col("score")) >= r.least)).count()
    assert r.g == "hot" and 5 <= kept < 10
    assert thresholds(df, 200, 20).count() == 0


def test_empty(spark):
    assert top_items(spark.createDataFrame([], EDGES), "g", "item", "score").count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_few_candidates(spark, n):
    df = spark.createDataFrame([("a", "x", 1e-300, 1), ("a", "y", 1e300, 1)], EDGES)
    assert [r.item for r in top_items(df, "g", "item", "score", n).orderBy("rank").collect()] == ["y", "x"][:n]

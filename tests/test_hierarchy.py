import random

import pytest
from pyspark.sql import functions as F

from cladewise.operators import hierarchy as H
from cladewise.operators import skew

EDGES = "child string, parent string, length double, at long, tie long, path string"


def solved(spark, rows, every=3):
    df = spark.createDataFrame([(c, p, ln, at, i, "x") for i, (c, p, ln, at) in enumerate(rows)], EDGES)
    return H.solve(spark, H.current_links(df, F.col("child"), F.col("parent"), F.col("length"), F.col("at"), F.col("tie")), every)


def brute(rows):
    cur = {}
    for i, (c, p, ln, at) in enumerate(rows):
        if c is not None and (c not in cur or ((at is not None, at or 0), i) > cur[c][0]):
            cur[c] = (((at is not None, at or 0), i), p, ln if ln is not None and ln >= 0 and ln == ln and ln != float("inf") else 0.0)
    out = {}
    for n in {*cur, *(v[1] for v in cur.values() if v[1] is not None)}:
        way, x, total = [], n, 0.0
        while x in cur and cur[x][1] is not None and x not in way:
            way.append(x)
            total += cur[x][2]
            x = cur[x][1]
        if x in way:
            out[n] = ("loop", min(way[way.index(x) :]))
        else:
            out[n] = (way, x, round(total, 6))
    return out


def result(ways):
    return {r.node: ("loop", r.cycle_key) if r.cycle_key is not None else (r.way, r.root, round(r.length, 6)) for r in ways.collect()}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("every", "hot_rows"), [(2, 3), (1000, 10_000)])
def test_random_forests_with_loops(spark, monkeypatch, seed, every, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rnd = random.Random(seed)
    n = 120
    rows = [(f"n{i}", f"n{rnd.randrange(max(1, i))}" if rnd.random() < 0.9 else None, rnd.choice([None, -1.0, float("nan"), 0.5, 1.0]), rnd.choice([None, 1, 2])) for i in range(1, n)]
    rows += [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}", 1.0, 3) for _ in range(12)] + [("self", "self", 1.0, 1), (None, "n1", 1.0, 9), rows[3]]
    assert result(solved(spark, rows, every)) == brute(rows)


@pytest.mark.parametrize("every", [4, 10_000])
def test_a_long_chain_and_a_long_cycle(spark, every):
    rows = [(f"c{i:04}", f"c{i - 1:04}", 1.0, 1) for i in range(1, 300)] + [(f"z{i:03}", f"z{(i + 1) % 70:03}", 1.0, 1) for i in range(70)] + [("tail", "z005", 1.0, 1)]
    got = result(solved(spark, rows, every))
    assert got == brute(rows) and got["tail"] == ("loop", "z000") and len(got["c0299"][0]) == 299


@pytest.mark.parametrize("every", [2, 3, 5])
def test_splitters_on_the_tail_of_a_cycle_without_one(spark, every):
    names = spark.range(400).select(F.concat(F.lit("k"), F.col("id")).alias("k")).select("k", (F.pmod(F.xxhash64("k"), F.lit(every)) == 0).alias("s"))
    split = [r.k for r in names.where("s").orderBy("k").collect()]
    plain = [r.k for r in names.where("not s").orderBy("k").collect()]
    a, b, c, d, e, f, g = plain[:7]
    p, q, r = split[:3]
    rows = [(a, b, 1.0, 1), (b, c, 1.0, 1), (c, a, 1.0, 1), (d, b, 1.0, 1), (p, d, 1.0, 1), (e, p, 1.0, 1), (f, e, 1.0, 1), (q, f, 1.0, 1), (g, q, 1.0, 1), (r, q, 1.0, 1)]
    got = result(solved(spark, rows, every))
    assert got == brute(rows) and set(got.values()) == {("loop", min(a, b, c))} and len(got) == 10


def test_report(spark):
    rows = [("b", "a", 1.0, 1), ("c", "b", 2.0, 1), ("d", "b", None, 1), ("x", "x", 1.0, 1)]
    ways = solved(spark, rows)
    got = {r.node: (r.path, r.depth, r.root, r.length, r.n_descendants, r.cycle_key) for r in H.hierarchy(ways).collect()}
    assert got == {"a": ("a", 0, "a", 0.0, 3, None), "b": ("a/b", 1, "a", 1.0, 2, None), "c": ("a/b/c", 2, "a", 3.0, 0, None), "d": ("a/b/d", 2, "a", 1.0, 0, None), "x": (None, None, None, None, None, "x")}
    assert sorted(tuple(r) for r in H.ancestors(ways).collect()) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]


def test_empty(spark):
    assert solved(spark, []).count() == 0
    assert result(solved(spark, [("a", None, 1.0, 1)])) == {"a": ([], "a", 0.0)}

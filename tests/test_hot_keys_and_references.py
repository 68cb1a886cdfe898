import datetime as dt

import pytest
from pyspark.sql import functions as F

from cladewise.functions.names import spelled
from cladewise.operators import skew
from cladewise.operators.hot_keys import dominant_keys, key_profiles
from cladewise.operators.references import dangling, dangling_report
from cladewise.operators.skew import census, hot_keys, lookup, lookup_known
from cladewise.store import Cuts, clear

LINKS = "species string, molecules string, reported_at timestamp, link_id long, n_rows int"
T = dt.datetime


def profiles(spark, rows, others=()):
    links = spark.createDataFrame(rows, LINKS)
    other = spark.createDataFrame(list(others), "key_field string, key_name string, amount long")
    return key_profiles(links, spelled("species"), spelled("molecules"), F.col("reported_at"), other, "species", "molecules"), links


def test_spelling(spark):
    names = [None, "", "  ", "\tNA\r\n", "a", " A  b\t\tC ", "x_y", "É "]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(spelled("n")).collect()
    assert [g[0] for g in got] == [None, None, None, None, "a", "a_b_c", "x_y", "é"]


def test_profiles_of_dirty_rows(spark):
    rows = [("A", "m", T(2021, 1, 2), 1, 9), (" a", "M", T(2021, 1, 1), 2, 9), ("a", None, None, 3, 9), (None, "m", None, 4, 9), ("na", "", None, 5, 9)]
    found, _ = profiles(spark, rows, [("species", "a", 5), ("species", "a", None), ("molecules", None, 3), ("x", "a", 1)])
    got = {(r.key_field, r.key_name): r for r in found.collect()}
    a, m = got[("species", "a")], got[("molecules", "m")]
    assert len(got) == 2
    assert (a.n_rows, a.n_partners, a.first_at, a.last_at, a.n_joined, a.amount_joined) == (3, 1, T(2021, 1, 1), T(2021, 1, 2), 6, 15)
    assert (m.n_rows, m.n_partners, m.n_joined, m.amount_joined) == (3, 1, 0, 0)


def test_joined_sums_equal_the_real_join(spark):
    rows = [(f"s{i % 3}", f"m{i % 5}", None, i, 0) for i in range(60)]
    others = [("species", f"s{i % 4}", i) for i in range(9)]
    found, links = profiles(spark, rows, others)
    real = links.join(spark.createDataFrame(others, "key_field string, species string, amount long"), "species").groupBy("species").agg(F.count("*").alias("n"), F.sum("amount").alias("a"))
    got = {r.key_name: (r.n_joined, r.amount_joined) for r in found.where("key_field = 'species'").collect()}
    assert got == {r.species: (r.n, r.a) for r in real.collect()}


def test_share_is_met_exactly(spark):
    rows = [("a", "x", None, i, 0) for i in range(2)] + [(None, None, None, i, 0) for i in range(98)]
    found, links = profiles(spark, rows)
    assert {(r.key_field, r.key_name) for r in dominant_keys(found, links, 0.02).collect()} == {("species", "a"), ("molecules", "x")}
    found, links = profiles(spark, [*rows, (None, None, None, 1, 0)])
    assert dominant_keys(found, links, 0.02).count() == 0


def test_empty_tables(spark):
    found, links = profiles(spark, [])
    assert found.count() == 0 and dominant_keys(found, links, 0.02).count() == 0


def test_lookup_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 5000).alias("k"), "id")
    table = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert {r.k for r in hot_keys(rows, ["k"], 0.5).collect()} == {0}
    got = lookup(rows, table, "k", F.col("id"))
    assert got.count() == 3000 and got.where("v != 2 * k").count() == 0
    nulls = rows.withColumn("k", F.when(F.col("id") > 5, F.col("k")))
    assert lookup(nulls, table, "k", F.col("id"), "left").where("v is null").count() == 6


@pytest.mark.parametrize("hot", [[], [0], [0, 3, 4999]])
def test_lookup_with_known_hot_keys(spark, hot):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 5000).alias("k"), "id")
    table = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup_known(rows, table, "k", F.col("id"), hot)
    assert got.count() == 3000 and got.where("v != 2 * k").count() == 0 and got.select("id").distinct().count() == 3000
    assert census(rows, "k", 2000) == (3000, [0]) and census(rows.limit(0), "k", 1) == (0, [])


def test_intermediate_tables_can_be_cleared(spark):
    cuts = Cuts(spark, "test")
    cuts.save("a", spark.range(3))
    assert clear(spark) > 0 and clear(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(cuts.root).count()


REFS, PARENTS = "field string, key string, id long, at timestamp, slice int", "field string, key string, since timestamp, until timestamp"


def brute(refs, parents):
    out = []
    for f, k, i, at, _ in refs:
        if f is None or k is None:
            continue
        own = [(a, b) for g, n, a, b in parents if (g, n) == (f, k)]
        if any(at is not None and a is not None and a <= at and (b is None or at < b) for a, b in own):
            continue
        began = any(at is not None and a is not None and a <= at for a, _ in own)
        out.append((f, i, "missing" if not own else "deleted" if began else "late"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [2, 10_000])
def test_dangling_against_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    import random

    rnd = random.Random(5)
    day = lambda: rnd.choice([None, *(T(2021, 1, d) for d in range(1, 9))])
    parents = [(rnd.choice("st"), rnd.choice(["a", "b", "c", "d", None]), day(), day()) for _ in range(60)]
    refs = [(rnd.choice("st"), rnd.choice(["a", "a", "a", "b", "c", "z", None]), i, day(), 1) for i in range(400)] + [("s", "a", 1, T(2021, 1, 3), 1)] * 2
    got = dangling(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert sorted(((r.field, r.id, r.reason) for r in got.collect()), key=repr) == brute(refs, parents)


def test_dangling_empty(spark):
    none_r, none_p = spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)
    one = spark.createDataFrame([("s", "a", 1, T(2021, 1, 1), 0)], REFS)
    assert dangling(none_r, none_p).count() == 0
    assert [r.reason for r in dangling(one, none_p).collect()] == ["missing"]
    assert [tuple(r) for r in dangling_report(dangling(one, none_p)).collect()] == [("s", "2021-01", "missing", 1)]

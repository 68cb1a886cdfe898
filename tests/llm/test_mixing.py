import math

import pytest
from pyspark.sql import functions as F

from cladewise.llm import mixing
from cladewise.llm.encode import encoder, vocabulary_path
from cladewise.llm.mixing import balance, goals, mix_sources, read_targets

TARGETS = "source string, target_share double, max_repeat int"


def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens string")
    return mix_sources(d, "doc_id", "text", F.col("source"), spark.createDataFrame(targets, TARGETS), F.col("source"), **kw)


def corpus(sizes):
    out, k = [], 0
    for source, n in sizes.items():
        for j in range(n):
            k += 1
            out.append((k, "word " * (1 + (7 * j) % 23), source, "x"))
    return out


def test_shares_and_repeats(spark):
    docs = [*corpus({"a": 400, "b": 60, "c": 200, "unlisted": 50}), (9001, None, "a", ""), (9002, "", "a", ""), (None, "word", "a", ""), (9003, "word word", None, "")]
    targets = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 2), ("nowhere", 0.05, 3), (None, 0.5, 1), ("d", None, 1)]
    taken, report = mix(spark, docs, targets)
    taken, report = taken.collect(), {r.source: r for r in report.collect()}
    enc, most = encoder(vocabulary_path()), {"a": 1, "b": 4, "c": 2}
    texts = {d[0]: d for d in docs}
    for r in taken:
        assert 1 <= r.copies <= most[r.source] and r.n_tokens == len(enc.encode(texts[r.doc_id][1])) and texts[r.doc_id][2] == r.source
    assert len({r.doc_id for r in taken}) == len(taken)
    total = sum(r.n_tokens * r.copies for r in taken)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(report[s].mix_share - share / 0.95) < 1.5 * 24 / total + 1e-9
        assert report[s].mix_tokens == sum(r.n_tokens * r.copies for r in taken if r.source == s)
    assert report["nowhere"].mix_tokens == 0 and sum(r.mix_share for r in report.values()) == pytest.approx(1)
    sizes = lambda source: [(r.n_tokens, r.copies) for r in taken if r.source == source]
    mean = lambda rows: sum(n * w for n, w in rows) / sum(w for _, w in rows)
    # c must shrink and gives up long documents first
    assert mean(sizes("c")) < 0.9 * mean([(len(enc.encode(d[1])), 1) for d in docs if d[2] == "c"])


def test_repeated_rows_are_one_document(spark):
    docs = corpus({"a": 20})
    one, _ = mix(spark, docs, [("a", 1.0, 2)])
    two, _ = mix(spark, docs + docs, [("a", 1.0, 2)])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert {r.copies for r in one.collect()} == {2}


def test_empty_tables(spark):
    taken, report = mix(spark, [], [("a", 1.0, 2)])
    assert taken.count() == 0 and report.first().mix_tokens == 0 and report.first().mix_share == 0
    taken, report = mix(spark, corpus({"a": 3}), [])
    assert taken.count() == 0 and report.count() == 0


def test_goals():
    assert goals({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}) == {"a": 20, "b": 20}
    assert goals({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, 100) == {"a": 50, "b": 20}
    assert goals({}, {"a": (1.0, 1)}) == {}


def exact(sizes, goal, cap):
    """The multiplier by halving, from the same optimality condition."""
    mean = sum(n * k for n, k in sizes) / sum(k for _, k in sizes)
    low, high = -1e4, 1e4
    for _ in range(200):
        x = (low + high) / 2
        tokens = sum(n * k * min(cap, math.exp(min(700, x * n / mean))) for n, k in sizes)
        low, high = (x, high) if tokens < goal else (low, x)
    return low


@pytest.mark.parametrize(("share", "cap"), [(0.02, 1), (1e-6, 1), (1.7, 2), (2.9, 3), (0.5, 4), (1.0, 1)])
def test_the_dual_has_the_exact_optimum_with_caps(spark, share, cap):
    a = [(n, 5) for n in range(1, 40)] + [(3000, 1)]
    b = [(7, 10)]
    sizes = spark.createDataFrame([("a", *x) for x in a] + [("b", *x) for x in b], "source string, n_tokens long, n long")
    have = sum(n * k for n, k in a)
    got = balance(spark, sizes, {"a": share * have, "b": 0.5 * 70}, {"a": cap, "b": 3})
    assert got["b"][0] == pytest.approx(math.log(0.5), abs=1e-8)
    if share == cap:
        assert got["a"][0] == math.inf
        return
    assert got["a"][0] == pytest.approx(exact(a, share * have, cap), rel=1e-5) and abs(got["a"][0]) > 1e-3
    if share > 1:
        assert math.exp(min(700, got["a"][0] * 3000 / got["a"][1])) > cap  # the cap binds


def test_no_rates_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ITERATIONS", 1)
    sizes = spark.createDataFrame([("a", n, 5) for n in range(1, 40)], "source string, n_tokens long, n long")
    with pytest.raises(RuntimeError):
        balance(spark, sizes, {"a": 17.0}, {"a": 1})


def test_targets(spark):
    df = spark.createDataFrame([("a", 0.1, None), ("a", 0.2, 3), ("b", float("nan"), 1), ("c", -1.0, 1), ("d", 0.3, -2)], TARGETS)
    assert read_targets(df, F.col("source")) == {"a": (0.2, 3), "d": (0.3, 0)}

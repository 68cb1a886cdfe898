import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import DATA
from pyspark.sql import functions as F

from cladewise.llm import spam as S
from cladewise.llm.spam import Cuts, chunk_pairs, corpus_chunks, described, pair_information, stuffed_pages, windows_of, words_of

WORDS = "the a plant grows near river and its leaves contain bitter resin which local people collect in spring before rain however no study has found".split()
ADS = "buy cheap tea powder oil capsules online discount best price free shipping sale offer".split()


def sentence(rnd):
    return " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(7, 14))).capitalize() + "."


def corpus(seed, n):
    rnd = random.Random(seed)
    docs = []
    for k in range(n):
        kind = rnd.choice(["ok", "ok", "ok", "spam", "tail"])
        text = " ".join(sentence(rnd) for _ in range(rnd.randint(4, 9)))
        if kind == "spam":
            ads = rnd.choice([" ".join(rnd.choice(ADS) for _ in range(90)), "\n".join(f"https://shop.x{rnd.randrange(99)}.test/item/{rnd.randrange(999)}.html" for _ in range(25)), " ".join("#" + rnd.choice(ADS) for _ in range(80))])
            text = ads + ("\n" + sentence(rnd) if rnd.random() < 0.5 else "")
        elif kind == "tail":
            text += "\n#tea #oil"
        docs.append((k, text, "spam" if kind == "spam" else "ok"))
    return docs


def test_finds_held_out_pages(spark):
    docs = corpus(7, 300)
    df = spark.createDataFrame([(k, t, "x") for k, t, _ in docs] + [(900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (None, docs[0][1], "x"), docs[1]], "doc_id long, text string, sum string")
    labels = spark.createDataFrame([(k, y) for k, _, y in docs if k % 3 == 0] + [(1, None), (0, docs[0][2])], "doc_id long, label string")
    rows = stuffed_pages(df, "doc_id", "text", labels).collect()
    got, want = {r.doc_id for r in rows}, {k for k, _, y in docs if y == "spam"}
    assert len(got) == len(rows)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_the_rule_without_labels(spark):
    docs = corpus(3, 200)
    df = spark.createDataFrame([(k, t) for k, t, _ in docs], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label string")
    assert {r.doc_id for r in stuffed_pages(df, "doc_id", "text", none).collect()} <= {k for k, _, _ in docs}
    assert stuffed_pages(df.limit(0), "doc_id", "text", none).count() == 0
    assert stuffed_pages(spark.createDataFrame([(1, "one"), (2, "x")], "doc_id long, text string"), "doc_id", "text", none).count() == 0


@pytest.mark.parametrize("chunk", [50, 500_000])
def test_information_of_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    texts = ["alpha beta " * 30, "alpha gamma " * 10, "delta beta " * 20, "epsilon zeta", "seven 7 8"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    counts = {}
    for t in texts:
        w = ["0" if x.isdigit() else x for x in t.split()]
        for p in zip(w, w[1:], strict=False):
            counts[p] = counts.get(p, 0) + 1
    cuts = Cuts(spark, "t")
    got = {(r.a, r.b): (r.n, r.pmi) for r in pair_information(cuts, chunk_pairs(corpus_chunks(cuts, df, "doc_id", "text"))).collect()}
    n = sum(counts.values())
    assert len(got) == sum(k > 1 for k in counts.values())
    for (a, b), k in counts.items():
        if k > 1:
            na, nb = sum(v for (x, _), v in counts.items() if x == a), sum(v for (_, y), v in counts.items() if y == b)
            assert got[S.hash_of(a), S.hash_of(b)][0] == k and np.isclose(got[S.hash_of(a), S.hash_of(b)][1], np.log(k * n / (na * nb)) * k / (k + 1), atol=1e-5)


def test_words_and_windows():
    assert words_of("Don't STOP: 12,5 mg 漢字ー x_y²") == ["don't", "stop", ":", "12", ",", "5", "mg", "漢", "字", "ー", "x", "_", "y", "²"]
    assert S.hash_of("12") == S.hash_of("²") != S.hash_of("一")
    lengths, doc = np.r_[np.full(1000, 5), 3, 10_000, 1], np.r_[np.zeros(1000, int), 1, 2, 2]
    w, n = windows_of(lengths, doc, 3)
    first = w[:1000]
    assert n.tolist() == [round(5000 / S.WINDOW), 1, 2] and first[-1] + 1 == n[0] and (np.diff(w) >= 0).all() and np.ptp(np.bincount(first)) <= 1
    assert w[1000:].tolist() == [n[0], n[0] + 1, n[0] + 2]


def test_every_pair_of_a_document_has_a_state(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc: r for r in described(Cuts(spark, "t"), df, "doc_id", "text").collect()}
    want = {r.doc_id: words_of(r.text) for r in df.where("text is not null").collect() if words_of(r.text)}
    assert set(rows) == set(want)
    for k, words in want.items():
        assert sum(rows[k].pairs) == len(rows[k].states) == len(words) - 1 and sum(rows[k].chars) == sum(map(len, words))


def test_own_counts_and_copies(spark):
    text = "red fish blue fish " * 6
    df = spark.createDataFrame([(1, text), (2, text), (3, "red fish"), (1, text)], "doc_id long, text string").where(F.col("text") != "")
    rows = described(Cuts(spark, "t"), df, "doc_id", "text").collect()
    own = {r.doc: np.frombuffer(bytes(r.states), np.uint8) % 4 for r in rows}
    assert (own[1] == own[2]).all() and own[1].tolist()[:4] == [3, 3, 3, 2] and own[3].tolist() == [0] and len(rows) == 4


def test_chunks_and_windows_are_held_a_few_at_a_time(spark, monkeypatch):
    df = spark.createDataFrame([(k, t) for k, t, _ in corpus(5, 60)], "doc_id long, text string")
    saved = Cuts(spark, "test").save("chunks", spark.range(50).coalesce(1), S.GROUP)
    groups = [m.row_group(k).num_rows for f in saved.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for k in range(m.num_row_groups)]
    assert sum(groups) == 50 and max(groups) == S.GROUP
    monkeypatch.setattr(S, "MOST_WINDOWS", 4)
    batch = described(Cuts(spark, "test"), df, "doc_id", "text").toArrow().combine_chunks().to_batches()[0]
    parts = [(b.num_rows, len(w.pairs)) for b, w in S._windows(batch)]
    assert sum(n for n, _ in parts) == batch.num_rows and all(k == 1 or n <= 4 for k, n in parts)

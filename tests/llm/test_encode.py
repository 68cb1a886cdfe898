import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladewise.llm.encode import TOKENIZERS, encode_corpus, encoder, halves, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
ENC = encoder(vocabulary_path())
PARTS = ["a", "the", "The", " ", "  ", "\n", "\r\n", "'s", "'", "'re", "!", "...", "1", "42", "é", "漢", "字", "。", " ", "ACGT", "<|endoftext|>", "\t", "x" * 40, "नमस्ते", "🙂"]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.integers(2, 30), st.integers(1, 5))
def test_tree_of_joins_equals_the_whole(text, size, window):
    parts = halves(text, size)
    assert "".join(parts) == text
    assert ENC.joined([ENC.encode(p) for p in parts], window) == ENC.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(2, 9))
def test_any_text(text, size):
    assert ENC.joined([ENC.encode(p) for p in halves(text, size)], 1) == ENC.encode(text)


def test_equals_the_other_library(reference):
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 50)))
        assert ENC.encode(text) == reference(text)


@pytest.mark.parametrize("fan", [2, 16])
def test_corpus(spark, reference, fan):
    rnd = random.Random(4)
    long = ["".join(rnd.choice("ACGT") for _ in range(3000)), "word " * 700, "漢字" * 900, " " * 2500, "a1b2" * 800]
    texts = [None, "", "  \n", "<|endoftext|> here", "short text", *long, long[0]]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(4, "short text", "x"), (5, long[0], "x"), (None, "no key", "x")]
    got = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "doc_id", "text", piece=256, fan=fan).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(((k, reference(t or "")) for k, t, _ in rows), key=repr)


def test_empty_table(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0

"""Keyword-stuffed and link-list pages, by pointwise mutual information of neighbouring words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.operators.skew import hot_from, lookup_known
from cladewise.store import Cuts

#: Characters of a window, about, white space not counted; a text is cut into windows of equal length.
WINDOW = 220
#: Words of a chunk of documents, about, whose pairs are looked up together, and chunks in a row group of their table.
CHUNK, GROUP = 500_000, 2
#: Documents, and windows, of which figures are taken at a time; a document of more windows comes alone.
DOCUMENTS, MOST_WINDOWS = 1000, 10_000
#: Labelled documents of each label that the weights are fitted on, those with the least hash of their id, and the number of pairs
#: up to which one of them is used for that.
LABELLED, LONGEST = 3000, 20_000
#: Rounds in which windows of labelled pages are told apart, Newton steps of each fit, and its ridge.
ROUNDS, STEPS, RIDGE = 3, 5, 5e-3
#: Bounds of the bins of information, of the counts of a pair in the corpus, and of those in its document.
PMI_EDGES = (-1.0, 0.0, 0.7, 1.4, 2.1, 2.8, 3.5, 4.2, 5.0, 6.0, 7.5)
KNOWN_EDGES, OWN_EDGES = (2, 5, 30), (2, 3, 6)
_Q, _KNOWN, _OWN = len(PMI_EDGES) + 1, len(KNOWN_EDGES) + 1, len(OWN_EDGES) + 1
_LEVELS = 1 + _Q * (_KNOWN - 1)
#: Coarse bins of information, by level: 0 for pairs that stand once in the corpus.
_FINE = np.r_[0, np.repeat(np.arange(_Q) + 1, _KNOWN - 1)]
_COARSE = np.array([0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 7])[_FINE]
#: A middle value for each bin of information, where only bins are at hand.
_MIDDLE = np.r_[0.0, -1.5, (np.array(PMI_EDGES[1:]) + np.array(PMI_EDGES[:-1])) / 2, 8.5][_FINE]

_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{M}]+(?:['’][\p{L}]+)*|\p{N}+|[^\s\p{L}\p{N}\p{M}]")
_ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*|[0-9]+|[^\sa-z0-9]")


def words_of(text: str) -> list[str]:
    """Words, numbers, marks, and single characters of scripts without blanks, in lower case."""
    low = text.lower()
    return (_ASCII_WORD if low.isascii() else _WORD).findall(low)


def hash_of(word: str) -> int:
    """A word's hash; all numbers are one word."""
    if unicodedata.category(word[0])[0] == "N":
        word = "0"
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def windows_of(lengths: np.ndarray, doc: np.ndarray, n_docs: int, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window of each word, numbered on over all documents, and the number of windows of each document.

    From the words' lengths and documents 0, 1 ... in order: equal parts of a text's characters; parts without a word don't count.
    """
    total = np.maximum(np.bincount(doc, lengths, minlength=n_docs), 1)
    n = np.maximum(np.rint(total / size), 1).astype(np.int64)
    ends = np.cumsum(lengths)
    before = np.r_[0, np.cumsum(np.bincount(doc, lengths, minlength=n_docs))[:-1]]
    middle = ends - lengths / 2 - before[doc]
    part = np.minimum((middle * n[doc] / total[doc]).astype(np.int64), n[doc] - 1)
    new = np.r_[True, (np.diff(doc) > 0) | (np.diff(part) > 0)] if len(doc) else np.zeros(0, bool)
    return np.cumsum(new) - 1, np.bincount(doc[new], minlength=n_docs)


# -- pairs of a chunk of documents ---------------------------------------------------------------------------------------------------
_CHUNK_COLS = "chunk long, doc array<{kind}>, sum array<long>, n_windows array<int>, chars array<int>, pairs array<int>, at array<int>, a array<long>, b array<long>, k array<int>"


class _Chunk:
    """Words of some documents: what is kept until they are many."""

    def __init__(self) -> None:
        self.docs: list[pa.Array] = []
        self.sums: list[int] = []
        self.words: list[np.ndarray] = []
        self.n = 0

    def row(self, number: int, hashes: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        n = np.array([len(w) for w in self.words])
        word, doc = np.concatenate(self.words), np.repeat(np.arange(len(n)), n)
        length = lengths[word]
        window, n_windows = windows_of(length, doc, len(n))
        chars = np.bincount(window, length, minlength=n_windows.sum()).astype(np.int32)
        same = doc[1:] == doc[:-1]
        # local numbers of the words keep the pair in one integer, whatever their hashes
        local, code = np.unique(word, return_inverse=True)
        key, at, k = np.unique(code[:-1][same] * len(local) + code[1:][same], return_inverse=True, return_counts=True)
        pairs = np.bincount(window[1:][same], minlength=n_windows.sum())
        lists = [self.sums, n_windows, chars, pairs, at, hashes[local[key // len(local)]], hashes[local[key % len(local)]], k]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        docs = pa.concat_arrays(self.docs)
        cols = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)]
        cols += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in zip(lists, types, strict=True)]
        return pa.RecordBatch.from_arrays(cols, ["chunk", "doc", "sum", "n_windows", "chars", "pairs", "at", "a", "b", "k"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk of documents: their windows, and the different pairs of neighbouring words with their places.

    Chunks are numbered by partition and order; the table is written, so what a lost task made again is never mixed up.
    """
    number = TaskContext.get().partitionId() << 32
    ids: dict[str, int] = {}
    hashes: list[int] = []
    lengths: list[int] = []
    held = _Chunk()
    for batch in batches:
        sums = batch.column("sum").to_pylist()
        for k, text in enumerate(batch.column("text").to_pylist()):
            words = words_of(text)
            if not words:
                continue
            try:
                found = [ids[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in ids:
                        ids[w] = len(hashes)
                        hashes.append(hash_of(w))
                        lengths.append(len(w))
                found = [ids[w] for w in words]
            held.docs.append(batch.column("doc").slice(k, 1))
            held.sums.append(sums[k])
            held.words.append(np.array(found, np.int64))
            held.n += len(words)
            if held.n >= CHUNK:
                yield held.row(number, np.array(hashes), np.array(lengths))
                number, held = number + 1, _Chunk()
                if len(ids) > CHUNK:
                    ids, hashes, lengths = {}, [], []
    if held.n:
        yield held.row(number, np.array(hashes), np.array(lengths))


def pair_information(cuts: Cuts, pairs: DataFrame) -> DataFrame:
    """Information of neighbouring words over the whole corpus: (a, b, n, n_a, n_b, pmi) of pairs that stand twice or more.

    pmi = ln(n(ab) * N / (n(a) n(b))), times n(ab) / (n(ab) + 1) as rare pairs overstate it, where n(a) and n(b) count the pairs
    that begin with a and end with b. ``pairs`` has (a, b, k). Counts are summed in the map tasks first. The counts of words also tell
    in how many pairs a word stands, so words of many pairs are known, 1,000 at most, and spread in the joins. A pair that stands once
    says nothing, and only counts in N, n(a) and n(b).
    """
    counts = cuts.save("counts", pairs.groupBy("a", "b").agg(F.sum("k").alias("n")))
    both, total = counts.where("n >= 2"), None
    for x, by in ("ab", "ba"):
        words = cuts.save(f"words-{x}", counts.groupBy(x).agg(F.sum("n").alias(f"n_{x}"), F.count_if(F.col("n") >= 2).alias("k")))
        size = words.agg(F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
        hot = [r[0] for r in words.where(F.col("k") >= hot_from(size.k)).select(x).collect()]
        both, total = lookup_known(both, words.drop("k"), x, F.col(by), hot), size.n
    n = F.col("n").cast("double")
    pmi = F.log(n * float(total) / (F.col("n_a").cast("double") * F.col("n_b"))) * n / (n + 1)
    return both.select("a", "b", "n", "n_a", "n_b", pmi.cast("float").alias("pmi"))


def _step(x: F.Column, edges: tuple) -> F.Column:
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return out


def corpus_chunks(cuts: Cuts, df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).where("doc is not null and text is not null")
    schema = _CHUNK_COLS.format(kind=df.schema[key].dataType.simpleString())
    return cuts.save("chunks", rows.select("doc", F.xxhash64("text").alias("sum"), "text").mapInArrow(_chunks, schema), GROUP)


def chunk_pairs(chunks: DataFrame) -> DataFrame:
    """(a, b, k): each chunk's pairs with their counts."""
    return chunks.select(F.explode(F.arrays_zip("a", "b", "k")).alias("x")).select("x.*")


def described(cuts: Cuts, df: DataFrame, key: str, text: str) -> DataFrame:
    """A row per document with words: (doc, sum, chars, pairs, states, pmi).

    ``chars`` and ``pairs`` are numbers per window; ``states`` holds a byte for each pair of neighbouring words of the whole text, its
    level of information over the corpus and its count in this document; ``pmi`` is the mean information. ``sum`` is a hash of the text,
    so that different texts under one id stay apart.

    A chunk of documents asks for each of its pairs once, so a common pair has one row per chunk in the join and no key is hot. What
    comes back is sorted by chunk behind the chunk's own row, so a task holds one chunk at a time.
    """
    kind = df.schema[key].dataType.simpleString()
    chunks = corpus_chunks(cuts, df, key, text)
    info = pair_information(cuts, chunk_pairs(chunks))
    level = 1 + _step(F.col("pmi"), PMI_EDGES) * (_KNOWN - 1) + _step(F.col("n"), KNOWN_EDGES[1:])
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b")).alias("i", "x")).select("chunk", "i", "x.a", "x.b")
    told = asked.join(info.select("a", "b", level.cast("byte").alias("level"), "pmi"), ["a", "b"]).select("chunk", "i", "level", "pmi")
    whole = F.struct("doc", "sum", "n_windows", "chars", "pairs", "at", F.size("a").alias("n"))
    first = chunks.select("chunk", F.lit(-1).alias("i"), whole.alias("row"))
    rows = told.unionByName(first, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "i")

    def states_of(row: pa.StructScalar, told: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        n_windows, chars, pairs, at = (row[c].values.to_numpy() for c in ("n_windows", "chars", "pairs", "at"))
        level, pmi = np.zeros(row["n"].as_py(), np.int64), np.zeros(row["n"].as_py())
        for i, its_level, its_pmi in told:
            level[i], pmi[i] = its_level, its_pmi
        ends = np.cumsum(n_windows)
        n_docs = len(n_windows)
        of_doc = np.add.reduceat(pairs, ends - n_windows)
        doc = np.repeat(np.arange(n_docs), of_doc)
        _, inverse, times = np.unique(doc * max(1, len(level)) + at, return_inverse=True, return_counts=True)
        state = (level[at] * _OWN + np.digitize(times[inverse], OWN_EDGES)).astype(np.uint8)
        last = np.cumsum(of_doc)
        mean = np.bincount(doc, pmi[at], minlength=n_docs) / np.maximum(of_doc, 1)
        offsets = pa.array(np.r_[0, ends], pa.int32())
        cols = [row["doc"].values, row["sum"].values, pa.ListArray.from_arrays(offsets, row["chars"].values), pa.ListArray.from_arrays(offsets, row["pairs"].values)]
        cols += [pa.array([state[e - n : e].tobytes() for e, n in zip(last, of_doc, strict=True)], pa.binary()), pa.array(mean)]
        return pa.RecordBatch.from_arrays(cols, ["doc", "sum", "chars", "pairs", "states", "pmi"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, told = None, []
        for batch in batches:
            i = batch.column("i").to_numpy()
            starts = np.flatnonzero(i < 0)
            for at, end in zip(np.r_[0, starts], np.r_[starts, len(i)], strict=True):
                if end > at and i[at] < 0:
                    if row is not None:
                        yield states_of(row, told)
                    row, told, at = batch.column("row")[int(at)], [], at + 1
                if end > at:
                    # copies, so that no batch is held for a piece of it
                    told.append((i[at:end].copy(), *(batch.column(c).slice(at, end - at).to_numpy(zero_copy_only=False).copy() for c in ("level", "pmi"))))
        if row is not None:
            yield states_of(row, told)

    return cuts.save("described", rows.mapInArrow(states, f"doc {kind}, sum long, chars array<int>, pairs array<int>, states binary, pmi double"))


# -- figures of windows -----------------------------------------------------------------------------------------------------------------
_SIZES = (_LEVELS * _OWN, 9 * 8 * 2, (_Q + 1) * 3 * 3)
_OTHERS = 10


class Windows:
    """Windows of some documents as counts of what their pairs are."""

    def __init__(self, chars: list[np.ndarray], pairs: list[np.ndarray], states: list[bytes]):
        self.n_windows = np.array([len(c) for c in chars])
        self.chars, self.pairs = np.concatenate(chars).astype(float), np.concatenate(pairs).astype(np.int64)
        self.doc = np.repeat(np.arange(len(chars)), self.n_windows)
        state = np.frombuffer(b"".join(states), np.uint8).astype(np.int64)
        self.window = np.repeat(np.arange(len(self.pairs)), self.pairs)
        self.level, self.own = state // _OWN, state % _OWN
        doc = self.doc[self.window]
        self.follows = np.r_[False, doc[1:] == doc[:-1]] if len(doc) else np.zeros(0, bool)

    def _share(self, code: np.ndarray, size: int) -> np.ndarray:
        counts = np.bincount(self.window * size + code, minlength=len(self.pairs) * size).reshape(-1, size)
        return counts / np.maximum(self.pairs, 1)[:, None]

    def figures(self) -> np.ndarray:
        """Roots of the shares of pairs, by information and repetition, by the information of two in a row, and by information and
        the repetition of two in a row; and the first of these over the whole document."""
        fine, coarse, own = _FINE[self.level], _COARSE[self.level], self.own
        before = np.where(self.follows, np.r_[0, coarse[:-1]] if len(coarse) else coarse, 8)
        own_before = np.where(self.follows, np.r_[0, np.minimum(own, 2)[:-1]] if len(own) else own, 0)
        first = self._share(self.level * _OWN + own, _SIZES[0])
        second = self._share((before * 8 + coarse) * 2 + (own > 0), _SIZES[1])
        third = self._share((fine * 3 + own_before) * 3 + np.minimum(own, 2), _SIZES[2])
        whole = np.add.reduceat(first * self.chars[:, None], np.cumsum(self.n_windows) - self.n_windows, axis=0)
        whole /= np.maximum(np.add.reduceat(self.chars, np.cumsum(self.n_windows) - self.n_windows), 1)[:, None]
        return np.sqrt(np.column_stack([first, second, third, whole[self.doc]]))

    def summary(self) -> np.ndarray:
        """Ten figures that need no labels: mean information and its spread, shares of repeated pairs, the information of those that
        repeat and of those that don't, shares of pairs seen once and of little and much information, and the number of pairs."""
        x, n = _MIDDLE[self.level], len(self.pairs)

        def mean(values: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
            w = np.ones(len(x)) if among is None else among.astype(float)
            return np.bincount(self.window, values * w, minlength=n) / np.maximum(np.bincount(self.window, w, minlength=n), 1)

        m = mean(x)
        spread = np.sqrt(np.maximum(mean(x * x) - m * m, 0))
        often = self.own >= 2
        return np.column_stack([m, spread, mean(self.own >= 1), mean(often), mean(x, often), mean(x, self.own < 1), mean(self.level == 0), mean(x < 1.5), mean(x > 6), np.log1p(self.pairs)])


#: The margin from which a window counts as stuffed by fitted weights.
MARGIN = -0.25
#: Weights of the ten figures, in standard deviations from the corpus, of their squares, and a constant: the rule where there are no
#: labels of both kinds. Rounded from a fit to a few hundred labelled pages in several languages.
DEFAULT = (-0.8, -0.4, 1.5, 0.6, 0.5, 0.3, 1.2, -0.6, -0.4, 0.0, -0.2, 0.3, 0.3, 0.0, 0.1, -0.1, 0.3, 0.1, 0.3, 0.3, -5.5)


class Model:
    """Linear weights of figures; either those fitted to labels, or the default ones over the corpus' means and deviations."""

    def __init__(self, weights: np.ndarray, constant: float, fitted: bool):
        self.weights, self.constant, self.fitted = weights, constant, fitted

    @staticmethod
    def default(mean: np.ndarray, deviation: np.ndarray) -> Model:
        w = np.array(DEFAULT)
        return Model(np.stack([mean, np.maximum(deviation, 1e-6), w[:_OTHERS], w[_OTHERS : 2 * _OTHERS]]), float(w[-1]), False)

    def margin(self, windows: Windows) -> np.ndarray:
        if self.fitted:
            return windows.figures() @ self.weights + self.constant - MARGIN
        mean, deviation, plain, square = self.weights
        z = np.clip((windows.summary() - mean) / deviation, -3, 3)
        return z @ plain + z * z @ square + self.constant


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's steps; the last column of ``x`` is the constant."""
    w, total = start.copy(), weight.sum()
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-9
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) / total + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4) / total)[:, None]).T @ x
        w -= np.linalg.solve(h + np.diag(ridge), g)
    return w


def learn(windows: Windows, spam: np.ndarray) -> Model:
    """Weights from labels of documents, ``spam`` by document.

    At first every window has its document's label. Then, in turns, windows of spam that don't look like it are taken out of
    it, though never so many that half of the page is left, and windows of other pages that look like spam lose most of their say.
    """
    figures = windows.figures()
    mean, deviation = figures.mean(0), figures.std(0)
    used = deviation > 1e-3
    x = np.column_stack([(figures[:, used] - mean[used]) / deviation[used], np.ones(len(figures))])
    is_spam, chars, doc = spam[windows.doc].astype(float), windows.chars, windows.doc
    base = np.sqrt(chars + 1) * np.where(is_spam > 0, (1 - is_spam).sum() / max(1, is_spam.sum()), 1.0) ** 0.5
    whole = np.maximum(np.bincount(doc, chars), 1)
    y, say = is_spam.copy(), np.ones(len(x))
    w = fit(x, y, base, np.zeros(x.shape[1]))
    for _ in range(ROUNDS):
        m = x @ w - MARGIN
        order = np.lexsort((-m, doc))
        before = np.cumsum(chars[order]) - chars[order]
        starts = np.cumsum(windows.n_windows) - windows.n_windows
        reached = np.zeros(len(x))
        reached[order] = (before - np.repeat(before[starts], windows.n_windows)) / whole[doc[order]]
        y = np.where(is_spam > 0, ((m > 0) | (reached <= 0.5)).astype(float), 0.0)
        say = np.where((is_spam == 0) & (m > 0), 0.3, 1.0)
        w = fit(x, y, base * say, w)
    weights = np.zeros(figures.shape[1])
    weights[used] = w[:-1] / deviation[used]
    return Model(weights, float(w[-1] - weights[used] @ mean[used]), True)


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Windows]]:
    ends = np.cumsum([len(c) for c in batch.column("chars")])
    at = 0
    while at < batch.num_rows:
        fits = np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_WINDOWS, "right") - at
        b = batch.slice(at, min(max(1, fits), DOCUMENTS))
        yield b, Windows(*([x.values.to_numpy() for x in b.column(c)] for c in ("chars", "pairs")), b.column("states").to_pylist())
        at += b.num_rows


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over windows, weighted by characters: their weight, the ten figures and their squares."""
    total = np.zeros(1 + 2 * _OTHERS)
    for batch in batches:
        for _, w in _windows(batch):
            z = w.summary() * 1.0
            total += np.r_[w.chars.sum(), w.chars @ z, w.chars @ (z * z)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "x"])


def model_of(rows: DataFrame, key: str, labels: DataFrame, spam: str, ok: str, labelled: int) -> Model:
    """The model for documents ``rows``, as ``described`` gives them; the driver gets at most 2 * ``labelled`` of up to LONGEST pairs."""
    known = labels.select(F.col(f"`{key}`").alias("doc"), "label").where(F.col("label").isin(spam, ok) & F.col("doc").isNotNull())
    one = known.groupBy("doc").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    some = None
    for name in (spam, ok):
        few = one.where(F.col("label") == name).orderBy(F.xxhash64("doc"), "doc").limit(labelled).select("doc", (F.lit(name) == spam).cast("int").alias("is_spam"))
        some = few if some is None else some.unionByName(few)
    taught = rows.where(F.length("states") <= LONGEST).join(F.broadcast(some), "doc").groupBy("doc", "sum").agg(*(F.first(c).alias(c) for c in ("is_spam", "chars", "pairs", "states"))).collect()
    taught = sorted(taught, key=lambda r: (repr(r.doc), r.sum))
    is_spam = np.array([r.is_spam for r in taught], bool)
    if is_spam.any() and not is_spam.all():
        return learn(Windows([np.array(r.chars) for r in taught], [np.array(r.pairs) for r in taught], [bytes(r.states) for r in taught]), is_spam)
    sums = {r.k: r.x for r in rows.select("chars", "pairs", "states").mapInArrow(_moments, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()}
    total = np.array([sums.get(k, 0.0) for k in range(1 + 2 * _OTHERS)])
    mean = total[1 : 1 + _OTHERS] / max(total[0], 1)
    return Model.default(mean, np.sqrt(np.maximum(total[1 + _OTHERS :] / max(total[0], 1) - mean * mean, 0)))


def stuffed_pages(df: DataFrame, key: str, text: str, labels: DataFrame, spam: str = "spam", ok: str = "ok", least_share: float = 0.5, labelled: int = LABELLED) -> DataFrame:
    """Documents of which more than ``least_share`` of the characters stand in stuffed windows: (key, share, pmi).

    Each pair of neighbouring words, numbers and marks of a text gets its pointwise mutual information from counts over the whole
    corpus. A window of the text is described by nothing else: how its pairs spread over bins of information, with how often each
    stands in the corpus and again in this document, and how such pairs follow each other. Salad of keywords has pairs of little
    information in a row; repeated collocations have the same informative pairs again and again. The words themselves are
    not looked at. Weights of these shares are fitted on at most ``labelled`` documents of each label (column ``label`` of
    ``labels``, joined by ``key``), those with the least hash of their id; ids with a null label or with both labels don't
    count. Without labels of both kinds a fixed rule over ten summaries of the same information decides, which finds fewer.

    Null, empty and blank texts, and documents with a null key, are never found. The result is distinct; each copy of a page under
    an id of its own comes out, and a row repeated under its id comes out once. Texts of any length are read whole.
    """
    cuts = Cuts(df.sparkSession, "spam")
    rows = described(cuts, df, key, text)
    model = model_of(rows, key, labels, spam, ok, labelled)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, w in _windows(batch):
                n = b.num_rows
                bad = np.bincount(w.doc, np.where(model.margin(w) > 0, w.chars, 0), minlength=n)
                share = bad / np.maximum(np.bincount(w.doc, w.chars, minlength=n), 1)
                yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(share), b.column("pmi")], ["doc", "share", "pmi"])

    shares = rows.select("doc", "chars", "pairs", "states", "pmi").mapInArrow(judge, f"doc {df.schema[key].dataType.simpleString()}, share double, pmi double")
    return shares.where(F.col("share") > least_share).groupBy("doc").agg(F.max("share").alias("share"), F.max("pmi").alias("pmi")).withColumnRenamed("doc", key)

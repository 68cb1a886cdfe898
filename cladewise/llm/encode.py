"""Encoding of a corpus with a public byte-level BPE, also of texts too long for one piece."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.store import Cuts

#: The folder of the public vocabularies; every executor needs it.
TOKENIZERS = os.environ.get("CLADEWISE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Characters of a piece; longer texts are encoded in pieces by different tasks and joined.
PIECE = 4_096
#: Neighbouring stretches that one task joins in a round; a text of n pieces takes log(n) / log(FAN) rounds.
FAN = 16
#: Tokens on each side of a join that are encoded again at first.
WINDOW = 16

#: Fixed value: the public pattern that this vocabulary splits texts with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the pattern always ends a match and starts anew, whatever stands around: after an ASCII letter, digit or mark (but an
#: apostrophe, which may begin a contraction) and before an ASCII character of another class.
_SAFE = re.compile(r"(?<=[A-Za-z])(?=[\x00-\x7f])(?![A-Za-z])|(?<=[0-9])(?=[\x00-\x7f])(?![0-9])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9 \t\r\n])")
#: One class only, thus inside of one match.
_RUN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+")


class Encoder:
    """A vocabulary of ranks and the splitting pattern; special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._enc = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._size = {i: len(x) for x, i in ranks.items()}

    def encode(self, text: str | None) -> list[int]:
        return self._enc.encode_ordinary(text) if text else []

    def text(self, ids: list[int]) -> str:
        return self._enc.decode_bytes(ids).decode()

    def _at(self, ids: list[int], n_bytes: int) -> int:
        """The number of first tokens that hold exactly so many bytes, or -1."""
        at = 0
        for k, i in enumerate(ids):
            if at >= n_bytes:
                return k if at == n_bytes else -1
            at += self._size[i]
        return len(ids) if at == n_bytes else -1

    def join(self, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
        """The ids of the joined text, from those of both halves.

        A window of tokens around the join is encoded again and doubled until it fits both sides. It fits if it reaches a
        safe place on each side, where the pattern starts anew; or, inside of one unsplit run, if its first and last token are
        those that were there: in a BPE a sequence is the encoding of its text if each two neighbours are that of theirs.
        A window that holds both halves is the encoding itself.
        """
        if not left or not right:
            return left + right
        w = window
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            if a == 0 and b == len(right):
                return self.encode(self.text(left + right))
            while True:
                try:
                    before, after = self.text(left[a:]), self.text(right[:b])
                    break
                except UnicodeDecodeError:
                    a, b = max(0, a - 1), min(len(right), b + 1)
            both = before + after
            safe = [m.start() for m in _SAFE.finditer(both)]
            start = 0 if a == 0 else next((p for p in safe if p < len(before)), -1)
            end = len(both) if b == len(right) else next((p for p in reversed(safe) if p > len(before)), -1)
            if start >= 0 and end >= 0:
                i = self._at(left[a:], len(both[:start].encode()))
                j = self._at(right[:b], len(both[len(before) : end].encode()))
                if i >= 0 and j >= 0:
                    return left[: a + i] + self.encode(both[start:end]) + right[j:]
            elif start < 0 and end < 0 and _RUN.fullmatch(both):
                mid = self.encode(both)
                if mid[0] == left[a] and mid[-1] == right[b - 1]:
                    return left[:a] + mid + right[b:]
            w *= 2

    def joined(self, parts: list[list[int]], window: int = WINDOW) -> list[int]:
        """Neighbours joined level by level, as a tree."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1], window) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []


@lru_cache(4)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(path, pattern)


def halves(text: str, size: int) -> list[str]:
    """Pieces of up to about ``size`` characters, cut in the middle again and again; at a safe place if one is near."""
    if len(text) <= size:
        return [text]
    mid = len(text) // 2
    reach = max(1, min(size // 8, 512))
    near = [m.start() for m in _SAFE.finditer(text, mid - reach, mid + reach)]
    cut = min(near, key=lambda p: abs(p - mid), default=mid)
    return halves(text[:cut], size) + halves(text[cut:], size)


def vocabulary_path(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    return f"{folder}/{name}.tiktoken"


def _ids(lists: list[list[int]]) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int32()))


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str | None = None, piece: int = PIECE, window: int = WINDOW, fan: int = FAN) -> DataFrame:
    """(key, ids): one row per row of ``df`` with the token ids of its text.

    Null and empty texts give an empty list, a null key stays null, blank texts are encoded as they are. Repeated rows all
    come out. Other columns don't matter. Strings of special tokens are ordinary text.

    Texts of up to ``piece`` characters are encoded where they are read, without a shuffle. Longer ones are cut into halves
    down to that size where they are read; pieces are spread over all tasks, repeated ones are encoded once, and in rounds up to
    ``fan`` neighbouring stretches of a text are joined by encoding growing windows again. No task joins more of a text in a
    round; the driver gets one number, the pieces of the longest text.
    """
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), _ids([enc.encode(t) for t in b.column("text").to_pylist()])], ["key", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, (name, t) in enumerate(zip(b.column("sum").to_pylist(), b.column("text").to_pylist(), strict=True)):
                parts = halves(t, piece)
                n = len(parts)
                key_of = b.column("key").slice(at, 1)
                for first in range(0, n, 64):
                    some = parts[first : first + 64]
                    cols = [pa.concat_arrays([key_of] * len(some)), pa.array([name] * len(some)), pa.array(range(first, first + len(some)), pa.int32()), pa.array([n] * len(some), pa.int32()), pa.array(some)]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "sum", "k", "n", "text"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _ids([enc.encode(t) for t in b.column(b.num_columns - 1).to_pylist()])], [*b.schema.names[:-1], "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _ids([enc.joined(x, window) for x in b.column(b.num_columns - 1).to_pylist()])], [*b.schema.names[:-1], "ids"])

    length = F.coalesce(F.length("text"), F.lit(0))
    short = rows.where(length <= piece).mapInArrow(whole, f"key {kind}, ids array<int>")
    long = rows.where(length > piece).select("key", F.sha2("text", 256).alias("sum"), "text")
    cols = ["key", "sum", "k", "n"]
    cuts = long.mapInArrow(cut, f"key {kind}, sum string, k int, n int, text string").groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    saved = Cuts(df.sparkSession, "encode").save("pieces", cuts.mapInArrow(pieces, f"key {kind}, sum string, k int, n int, copies long, ids array<int>"))
    most = saved.agg(F.max("n")).first()[0] or 0
    done = saved
    while most > 1:
        near = done.withColumn("at", F.floor(F.col("k") / fan).cast("int")).groupBy("key", "sum", "at", "n", "copies").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x"))
        rows_of = near.select("key", "sum", F.col("at").alias("k"), "n", "copies", F.col("x.ids").alias("ids"))
        done = rows_of.mapInArrow(join, f"key {kind}, sum string, k int, n int, copies long, ids array<int>")
        most = -(-most // fan)
    again = done.select("key", "ids", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("key", "ids")
    return short.unionByName(again).withColumnRenamed("key", key)


def token_counts(batches: Iterator[pa.RecordBatch], path: str, piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Adds the number of tokens of the last column, a text, in its place. Long texts are encoded piece by piece."""
    enc = encoder(path)

    def count(t: str | None) -> int:
        if not t:
            return 0
        return len(enc.encode(t)) if len(t) <= piece else len(enc.joined([enc.encode(p) for p in halves(t, piece)]))

    for b in batches:
        n = pa.array([count(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*b.schema.names[:-1], "n_tokens"])

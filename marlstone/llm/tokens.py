"""Encoding of whole texts with public tokenizers by tree concatenation (problem 7)."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; never copied into the repository.
TOKENIZERS = "/opt/tokenizers"
#: How many neighbours a task joins, and the most characters a string column can hold.
FAN, MOST_CHARS = 16, 1 << 31


#: How the vocabulary splits text before its merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    """The encoder of a rank file, and each token's length in bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
    for token, i in ranks.items():
        width[i] = len(token)
    return tiktoken.Encoding("marlstone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, width


class Coded(NamedTuple):
    """A stretch of text as UTF-8, its ids, and the byte at which each token ends."""

    text: bytes
    ids: np.ndarray
    ends: np.ndarray

    def begin(self, i: int) -> int:
        return int(self.ends[i - 1]) if i else 0

    def inside(self, at: int) -> bool:
        """Whether the byte at ``at`` continues a character."""
        return 0 < at < len(self.text) and self.text[at] & 0xC0 == 0x80


class TreeEncoder:
    """Exact ids of texts of any length; texts over ``leaf_chars`` are encoded in halves and joined.

    Why a join is exact: the byte-level pre-tokenizer splits a text by a scan that
    looks at most three characters ahead and never back, and inside one split
    BPE's result is the only one of whose neighbouring tokens every pair encodes to
    itself.  So once a window around the cut, encoded anew, starts with the token
    that the left half has there and ends with one that the right half has there,
    whole and at the same places, everything outside the window stands.  The window
    grows (twice as many tokens a side) until that holds, at last to both halves.
    """

    def __init__(self, path: str, leaf_chars: int = 4096, start: int = 16):
        self.raw, self.width = _tokenizer(path)
        self.leaf, self.start = max(2, leaf_chars), start

    def leaves(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return [text]
        half = len(text) // 2
        return self.leaves(text[:half]) + self.leaves(text[half:])

    def coded(self, text: str, ids: list[int] | np.ndarray | None = None) -> Coded:
        ids = np.asarray(self.raw(text) if ids is None else ids, dtype=np.int32)
        return Coded(text.encode("utf-8"), ids, np.cumsum(self.width[ids]))

    def encode(self, text: str) -> list[int] | np.ndarray:
        return self.raw(text) if len(text) <= self.leaf else self.tree(text).ids

    def tree(self, text: str) -> Coded:
        return self.concat([self.coded(t) for t in self.leaves(text)])

    def concat(self, parts: list[Coded]) -> Coded:
        """Joins neighbours pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: Coded, right: Coded) -> Coded:
        if not left.text or not right.text:
            return left if left.text else right
        n_left, n_right, shift, w = len(left.ids), len(right.ids), len(left.text), self.start
        while True:
            a, b = max(0, n_left - w), min(n_right, w)
            # Whole characters only: a token that shares its character with a neighbour can be no end of a window.
            while 0 < a and left.inside(left.begin(a)):
                a -= 1
            while b < n_right and right.inside(int(right.ends[b - 1])):
                b += 1
            low, high = left.begin(a), int(right.ends[b - 1]) if b < n_right else len(right.text)
            window = self.coded((left.text[low:] + right.text[:high]).decode("utf-8"))
            if (a == 0 and b == n_right) or self._agrees(left, a, low, right, b, shift, window):
                ids = np.concatenate((left.ids[:a], window.ids, right.ids[b:]))
                return Coded(left.text + right.text, ids, np.cumsum(self.width[ids]))
            w *= 2

    @staticmethod
    def _agrees(left: Coded, a: int, low: int, right: Coded, b: int, shift: int, window: Coded, run: int = 4) -> bool:
        """The window's first and last ``run`` tokens are the halves' own, at their own places."""
        if len(window.ids) < 2 * run:
            return False
        if a > 0 and not (np.array_equal(left.ids[a : a + run], window.ids[:run]) and np.array_equal(left.ends[a : a + run] - low, window.ends[:run])):
            return False
        if b < len(right.ids):
            at = max(0, b - run)
            return np.array_equal(right.ids[at:b], window.ids[-run:]) and np.array_equal(right.ends[at:b] + shift - low, window.ends[-run:])
        return True


def encode_corpus(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", leaf_chars: int = 4096, spread_chars: int = 4_000_000,
    tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row by a byte-level rank file, without special tokens.

    Null and empty text have the empty list.  Strings of special tokens inside a
    text are ordinary text.  Texts over ``leaf_chars`` are encoded in halves by tree
    concatenation inside their task; texts over ``spread_chars`` are cut into such
    blocks that other tasks encode, and joined by a tree of tasks.  A text is never
    cut short.  Repeated doc_ids keep one output row per input row.
    """
    path = f"{tokenizers}/{vocabulary}.tiktoken"
    rows = df.select(F.col(doc_id).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    near = rows.where(F.length("t") <= spread_chars)
    ints = pa.list_(pa.int32())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TreeEncoder(path, leaf_chars)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array([enc.encode(t) for t in batch.column("t").to_pylist()], ints)], names=["d", "ids"])

    d_type = rows.schema["d"].dataType.simpleString()
    out = near.mapInArrow(whole, f"d {d_type}, ids array<int>")

    # One row per block of a huge text; blocks of one text go to different tasks.
    huge = rows.where(F.length("t") > spread_chars).withColumn("u", F.monotonically_increasing_id())
    block = max(leaf_chars, spread_chars // 8)
    cut = huge.select(
        "d", "u", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"(length(t) - 1) div {block}")), lambda i: F.substring(F.col("t"), i * block + 1, F.lit(block)))).alias("n", "t")
    ).repartition("u", "n")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TreeEncoder(path, leaf_chars)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([enc.tree(t).ids for t in batch.column("t").to_pylist()], ints)], names=["d", "u", "n", "t", "ids"])

    schema = f"d {d_type}, u bigint, n int, t string, ids array<int>"
    coded = cut.mapInArrow(blocks, schema)

    def joined(pdf):
        enc = TreeEncoder(path, leaf_chars)
        pdf = pdf.sort_values("n")
        got = enc.concat([enc.coded(t, i) for t, i in zip(pdf["t"], pdf["ids"], strict=True)])
        return pdf.iloc[:1].assign(n=[int(pdf["n"].iloc[0]) // FAN], t=[got.text.decode("utf-8")], ids=[got.ids])

    # A tree of tasks: each joins up to FAN neighbours, until one row a text is left; the last level's row is the result's own.
    for _ in range(max(1, math.ceil(math.log(MOST_CHARS / block, FAN)))):
        coded = coded.groupBy("u", F.expr(f"n div {FAN}").alias("_g")).applyInPandas(lambda key, pdf: joined(pdf), schema)
    return out.unionByName(coded.select("d", "ids")).select(F.col("d").alias(doc_id), "ids")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every row, in one pass; null and empty text have 0."""
    path = f"{tokenizers}/{vocabulary}.tiktoken"
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", n_tokens bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TreeEncoder(path)
        for batch in batches:
            n = [len(enc.encode(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(count, schema)

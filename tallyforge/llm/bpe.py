"""Byte-level BPE: texts to token ids by a file of ranks, and ids back to bytes.

Method: a pattern splits the text into pieces; a piece that is a token itself is that
token, and any other is merged: a segment tree over the piece's byte positions holds
at each node the leftmost least rank of the pairs below it. The root names the next
merge, which changes three leaves: the merged pair's, that of the neighbour before
it and that of the part taken in. So a piece of n bytes takes about n log n steps,
however long it is. Short pieces are remembered between texts, in a table of
bounded size.

No shuffle: both directions work row by row. The vocabulary is read in each Python
worker, from a path that all workers have.

Defined cases: a null text encodes as the empty one, and null ids decode to nothing;
special tokens aren't looked for, so their strings are text; bytes that aren't UTF-8
read as U+FFFD; an id that no token has raises; other columns travel along, and those
named as an added one give way to it; repeated rows are rows of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, small_batches, table
from .token_counts import VOCABULARY, split_pattern

# Pieces up to so many characters are remembered, so many of them.
REMEMBERED_LENGTH, REMEMBERED = 48, 300_000
# Above all ranks: no token.
NO_RANK = 1 << 40


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Rank by token, from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def tokens_of(path: str) -> dict[int, bytes]:
    """Token by id."""
    return {rank: token for token, rank in ranks_of(path).items()}


@lru_cache(maxsize=4)
def pieces_of(path: str):
    """The compiled pattern that belongs to a vocabulary. White space is Unicode's, without U+001C to U+001F."""
    import regex

    return regex.compile(split_pattern(path.rpartition("/")[0]))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the pair of least rank, leftmost of equals, is merged until no pair is a token.

    Leaf i of the tree has rank and place, in one number, of the pair of the part that begins at byte i and the next one.
    """
    n, rank = len(piece), ranks.get
    size = max(2, n)
    shift = size.bit_length()
    place, none = (1 << shift) - 1, NO_RANK << shift
    after, before = [*range(1, n + 1), n], [*range(-1, n)]
    tree = [none] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = rank(piece[i : i + 2], NO_RANK) << shift | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    while (least := tree[1]) < none:
        i = least & place
        gone = after[i]
        after[i] = end = after[gone]
        before[end] = i
        # Three leaves change: the part taken in, the pair at i, and the pair before it. Their ways to the root soon meet.
        x = y = size + i
        z = size + gone
        tree[z] = none
        tree[y] = rank(piece[i : after[end]], NO_RANK) << shift | i if end < n else none
        if (p := before[i]) >= 0:
            x = size + p
            tree[x] = rank(piece[p:end], NO_RANK) << shift | p
        while z > 1:
            z >>= 1
            y >>= 1
            x >>= 1
            if x != y and x:
                a, b = tree[2 * x], tree[2 * x + 1]
                tree[x] = a if a < b else b
            if y != z and y:
                a, b = tree[2 * y], tree[2 * y + 1]
                tree[y] = a if a < b else b
            a, b = tree[2 * z], tree[2 * z + 1]
            tree[z] = a if a < b else b
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pieces(dict):
    """The ids of each piece, remembered between texts in two generations: when the younger is full the older is forgotten, but for what was met since. Long pieces are worked out each time."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = self.older.get(piece)
        if out is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            out = (whole,) if whole is not None else tuple(merged(data, self.ranks))
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=4)
def remembered(path: str) -> Pieces:
    """One table of pieces in each Python worker."""
    return Pieces(ranks_of(path))


def encode(text: str, path: str = VOCABULARY) -> np.ndarray:
    """The token ids of a text."""
    return np.fromiter(chain.from_iterable(map(remembered(path).__getitem__, pieces_of(path).findall(text))), np.int32)


def decode(ids: Iterable[int], path: str = VOCABULARY) -> bytes:
    """The bytes of token ids."""
    return b"".join(map(tokens_of(path).__getitem__, ids))


def with_ids(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """Adds ids, the tokens of the whole text, to each row."""

    def columns(texts: list[bytes]) -> dict:
        return {"ids": [encode(x.decode("utf-8", "replace"), vocabulary) for x in texts]}

    return map_texts(docs, columns, "ids array<int>", text, keep)


def with_decoded(encoded: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds decoded, the bytes of the tokens in `ids`, to each row."""
    small_batches(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != "decoded"]
    source = encoded.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(len(kept))
            made = pa.array([decode(x.values.to_numpy().tolist(), vocabulary) for x in listed], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], schema=pa.schema([*list(batch.schema)[:-1], pa.field("decoded", pa.binary())]))

    return source.mapInArrow(run, source.select(*[F.col(f"`{c}`") for c in kept]).schema.add("decoded", "binary"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of what they decode to."""
    both = with_decoded(with_ids(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

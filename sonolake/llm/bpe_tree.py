"""Byte-level BPE encoding and decoding as a reduction over a binary tree.

A text is halved down to leaves; a leaf is split by the tokenizer's pattern and each match is merged
by rank. Two neighbours are joined by encoding a window over their boundary anew, which grows until
what lies outside cannot change:

* on the left, matches that end LOOK characters before the boundary are final: no alternative of the
  pattern looks further than that past its match, and none looks back;
* on the right, the window has reached a match end that the right neighbour has too. From a common
  match end on, both go the same way, as the pattern does not look back.

Inside a long match the same is done with tokens. Merges go by rank, so `t1..tn` is the encoding of its
bytes exactly if each pair `ti, ti+1` is the encoding of its own bytes: the first merge over a boundary
would already happen with the two neighbours alone. The window therefore stops as soon as the two pairs
at its rims encode to themselves.

Defined results: a null or empty text has no tokens; texts of any length are encoded whole; special tokens'
strings are ordinary text. Rows are independent, so ties, repeated rows and clashing columns change nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

LOOK = 3
LEAF_CHARS = 2048
LEAF_BYTES = 64
CACHE = 400_000


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file, and the pattern that splits texts."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


class TreeCodec:
    """ranks: token bytes to id, ordered by merge priority; all 256 single bytes are tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str | None = None, pattern: str | None = None) -> TreeCodec:
        own, own_pattern = default_vocabulary()
        with open(path or own, "rb") as f:
            return cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}, pattern or own_pattern)

    # merges inside one match

    def merge(self, raw: bytes) -> list[bytes]:
        """Merge neighbours by lowest rank, the leftmost first."""
        parts, rank = [raw[i : i + 1] for i in range(len(raw))], self.ranks.get
        none = len(self.ranks) + (1 << 30)
        costs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def settled(self, a: bytes, b: bytes) -> bool:
        return self.merge(a + b) == [a, b]

    def join_tokens(self, u: list[bytes], v: list[bytes]) -> list[bytes]:
        k = 1
        while True:
            left, right = u[-k:], v[:k]
            mid = self.tree(b"".join(left + right)) if k > LEAF_BYTES else self.merge(b"".join(left + right))
            if (k >= len(u) or self.settled(u[-k - 1], mid[0])) and (k >= len(v) or self.settled(mid[-1], v[k])):
                return u[:-k] + mid + v[k:]
            k *= 2

    def tree(self, raw: bytes) -> list[bytes]:
        """As merge(), by halves; the halves are joined level by level, so depth is no matter."""
        level = [self.merge(raw[i : i + LEAF_BYTES]) for i in range(0, len(raw), LEAF_BYTES)]
        while len(level) > 1:
            level = [self.join_tokens(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def pack(self, piece: str) -> bytes:
        """The ids of one match as little-endian unsigned 32-bit integers."""
        if (got := self.cache.get(piece)) is None:
            raw = piece.encode()
            own = self.ranks.get(raw)
            ids = [own] if own is not None else [self.ranks[t] for t in (self.merge(raw) if len(raw) <= LEAF_BYTES else self.tree(raw))]
            got = np.array(ids, "<u4").tobytes()
            if len(piece) <= 32:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = got
        return got

    # a whole text

    def leaf(self, text: str) -> tuple[list[str], list[bytes]]:
        pieces = self.split(text)
        return pieces, [self.pack(p) for p in pieces]

    def join(self, text: str, at: int, end: int, left: tuple, right: tuple) -> tuple[list[str], list[bytes]]:
        """left covers text up to at, right from at to end."""
        pieces, packs = left
        keep, start = len(pieces), at
        while keep and start > at - LOOK:
            keep -= 1
            start -= len(pieces[keep])
        width = 32
        while True:
            to = min(end, at + width)
            ends, p = {at: 0}, at
            for i, piece in enumerate(right[0]):
                p += len(piece)
                if p > to:
                    break
                ends[p] = i + 1
            window, p = self.split(text[start:to]), start
            for i, piece in enumerate(window):
                p += len(piece)
                if p in ends and (to == end or p <= to - LOOK):
                    mid, rest = window[: i + 1], ends[p]
                    return pieces[:keep] + mid + right[0][rest:], packs[:keep] + [self.pack(x) for x in mid] + right[1][rest:]
            width *= 2

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        cuts = [*range(0, len(text), LEAF_CHARS), len(text)]
        level = [(a, b, self.leaf(text[a:b])) for a, b in zip(cuts, cuts[1:])]
        while len(level) > 1:
            level = [(a[0], level[i + 1][1], self.join(text, a[1], level[i + 1][1], a[2], level[i + 1][2])) if i + 1 < len(level) else a for i, a in enumerate(level) if not i % 2]
        return b"".join(level[0][2][1])

    def decode(self, ids: bytes) -> bytes:
        """Concatenates token bytes up the tree; an unknown id is an error."""
        level = [self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]
        while len(level) > 1:
            level = [b"".join(level[i : i + 64]) for i in range(0, len(level), 64)]
        return level[0] if level else b""


def encode(docs: DataFrame, key: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, n_tokens long, ids binary (little-endian unsigned 32-bit integers) of each row's `text`."""
    ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec.load(path, pattern)
        for b in batches:
            ids = [codec.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    return docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `decoded` (binary), the bytes that the column `ids` stands for; null ids are none."""
    ready(encoded.sparkSession)
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec.load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([codec.decode(x or b"") for x in b.column(at).to_pylist()], pa.binary())], [*b.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the bytes they decode to, for every row."""
    return decode(encode(docs)).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Marginal likelihood of texts over all segmentations into the pieces of an existing subword vocabulary.

A piece is drawn with its unigram probability; a word's probability is the sum over all ways to write it as
pieces, found by the forward recursion in log space:

    alpha[j] = logsumexp over pieces p that end at j of alpha[j - len(p)] + log P(p)

A text is its words and an end, which is drawn like a piece. The vocabulary's own scores give the pieces' weights (see
piece_weights); they are the mean of a Dirichlet prior of PRIOR pseudo-counts, and a fixed number of forward-backward passes over
the training words, each as often as it occurs, add what the corpus says. No word of the corpus becomes a piece: every word,
known or not, gets its probability from its segmentations alone. Single bytes are always pieces, so that every word has one.

Words, not texts, meet in a shuffle: each task gathers its texts into blocks and sends one short row for each distinct
word of a block. A word's count and its marginal probability are found once in the corpus and go back by block; the
lists of which text holds which word stay in one row a block, and each block sums up its texts. The end is a token of every
text, so it needs no row.

Defined results: a null or empty text has the end as its only token; a null id is never learned from unless its
remainder says so (it counts as the empty text); repeated rows count each; without training rows N and V
are 0 and base_score uses N + 0.5; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, ready, text_bytes

#: The most bytes of text, and texts, that one block gathers; a text is never split.
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 65_000
FIT_PASSES = 3
#: Pseudo-counts that the vocabulary's weights stand for.
PRIOR = 1000.0
#: Added to a rank before its inverse is taken (Zipf's law as Mandelbrot states it).
RANK_SHIFT = 10.0
#: Distinct words that are scored at once.
LOT = 50_000
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Longer words are scored one by one.
LONG = 512
LOG10 = math.log(10)
MULT = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xBF58476D1CE4E5B9)


def default_vocabulary() -> tuple[list[bytes], np.ndarray]:
    """Pieces of the public 32k vocabulary, lower-cased, a word's start written as a space, and their weights; what lower-casing makes equal adds up."""
    import public_tokenizers as P
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    normal = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    weights: dict[bytes, float] = {}
    for i, x in zip(normal, piece_weights(np.array([m.get_score(i) for i in normal])), strict=True):
        piece = m.id_to_piece(i).replace("▁", " ").encode().lower()
        weights[piece] = weights.get(piece, 0.0) + float(x)
    return list(weights), np.array(list(weights.values()))


def piece_weights(scores: np.ndarray) -> np.ndarray:
    """Probabilities of pieces from a vocabulary's scores.

    Scores of a unigram vocabulary are log probabilities (their exponentials sum to about 1) and are taken as they are. Merge
    vocabularies score a piece by its negative rank, which is no log probability; there a piece weighs 1 / (rank + RANK_SHIFT).
    """
    with np.errstate(over="ignore"):
        p = np.exp(scores)
    if not 0.9 < p.sum() < 1.1:
        p = 1 / (np.argsort(np.argsort(-scores, kind="stable"), kind="stable") + RANK_SHIFT)
    return p / p.sum()


class Lattice:
    """pieces: bytes. logp: their natural logarithms; single bytes that are no piece follow, with SINGLE of the least weight."""

    SINGLE = 0.1

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        known = set(pieces)
        missing = [x for x in (bytes([i]) for i in range(256)) if x not in known]
        self.pieces = list(pieces) + missing
        self.logp = np.concatenate([logp, np.full(len(missing), logp.min() + math.log(self.SINGLE))])
        self.table: dict[bytes, tuple[int, float]] = {}
        self.longest = max(map(len, self.pieces))
        self.lengths = {len(p) for p in self.pieces}
        self.slots = np.full(SLOTS + 64, -1, np.int64)
        self.names = np.zeros(SLOTS + 64, np.uint64)
        self.probes = 1
        for i, p in enumerate(self.pieces):
            h = self.hash_one(p)
            at = (h * int(SPREAD) & 0xFFFFFFFFFFFFFFFF) >> (64 - SLOT_BITS)
            k = 0
            while self.slots[at + k] >= 0:
                k += 1
            self.slots[at + k], self.names[at + k] = i, h
            self.probes = max(self.probes, k + 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, or -1."""
        at = ((h * SPREAD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = np.where(self.names[at] == h, self.slots[at], -1)
        for k in range(1, self.probes):
            out = np.where(self.names[at + k] == h, self.slots[at + k], out)
        return out

    @staticmethod
    def hash_one(p: bytes) -> int:
        h = 0
        for c in p:
            h = (h * int(MULT) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """words: (n, length) bytes. For start i and end j: the piece's number, or -1. Hits are checked by their bytes' 64-bit hash."""
        n, length = words.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * MULT + words[:, j].astype(np.uint64) + np.uint64(1)
        out, power = {}, np.ones(1, np.uint64)
        for k in range(1, min(length, self.longest) + 1):
            power = power * MULT
            if k in self.lengths:
                for i in range(length - k + 1):
                    found = self.find(prefix[i + k] - prefix[i] * power)
                    if k == 1 or (found >= 0).any():
                        out[i, i + k] = found
        return out

    def forward(self, words: np.ndarray, expect: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's marginal probability; adds expected piece counts to `expect`, times weights."""
        n, length = words.shape
        edges = self.edges(words)
        logp = np.append(self.logp, -np.inf)
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        into: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (i, j), ids in edges.items():
            into.setdefault(j, []).append((i, ids))
        for j in range(1, length + 1):
            terms = np.stack([alpha[i] + logp[ids] for i, ids in into[j]])
            top = terms.max(0)
            alpha[j] = top + np.log(np.exp(terms - top).sum(0))
        if expect is not None:
            beta = np.full((length + 1, n), -np.inf)
            beta[length] = 0
            for j in range(length, 0, -1):
                for i, ids in into[j]:
                    beta[i] = np.logaddexp(beta[i], logp[ids] + beta[j])
            for (i, j), ids in edges.items():
                share = np.exp(alpha[i] + logp[ids] + beta[j] - alpha[length]) * weights
                expect += np.bincount(ids[ids >= 0], share[ids >= 0], len(expect))
        return alpha[length]

    def score(self, words: list[bytes], expect: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
        """Each word is scored with a space before it. Words of one length go together; long ones in small lots."""
        out = np.zeros(len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cuts) if len(words) else []:
            size = int(lengths[same[0]]) + 1
            lot = max(1, 2_000_000 // (size * min(size, self.longest)))
            for at in range(0, len(same), lot):
                part = same[at : at + lot]
                rows = np.frombuffer(b"".join(b" " + words[i] for i in part), np.uint8).reshape(len(part), size)
                if size > LONG:
                    out[part] = [self.scalar(bytes(r), expect, 1.0 if weights is None else weights[i]) for r, i in zip(rows, part, strict=True)]
                else:
                    out[part] = self.forward(rows, expect, None if weights is None else weights[part])
        return out

    def scalar(self, raw: bytes, expect: np.ndarray | None, weight: float) -> float:
        """forward() for one long word, with memory in proportion to its length."""
        if not self.table:
            self.table = {p: (i, v) for i, (p, v) in enumerate(zip(self.pieces, self.logp.tolist(), strict=True))}
        n, get = len(raw), self.table.get
        alpha = [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = [alpha[i] + hit[1] for i in range(max(0, j - self.longest), j) if (hit := get(raw[i:j]))]
            top = max(terms)
            alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        if expect is not None:
            beta = [0.0] * (n + 1)
            for i in range(n - 1, -1, -1):
                hits = [(hit[0], hit[1] + beta[j]) for j in range(i + 1, min(n, i + self.longest) + 1) if (hit := get(raw[i:j]))]
                top = max(t for _, t in hits)
                beta[i] = top + math.log(sum(math.exp(t - top) for _, t in hits))
                for piece, t in hits:
                    expect[piece] += weight * math.exp(alpha[i] + t - alpha[n])
        return alpha[n]


def index(docs: DataFrame, train: object) -> DataFrame:
    """block, word, c (training count), slot (the word's place in the block). A row with a null word holds a block: c training texts, and post.

    post: numbers of texts and words; doc_id, whether it is known, and n_tokens of each text; where each word's list ends;
    the lists, 3 bytes a text: its place in the block (2, low first) and how often it holds the word; above 255 the entry is repeated.
    """
    columns = "block long, word binary, c long, slot int, post binary"
    names_of = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 24, 0
        ids: list[int | None] = []
        learn: list[bool] = []
        parts: list[np.ndarray] = []
        names: dict[bytes, int] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            if not ids:
                return
            counts = np.array([len(p) for p in parts])
            doc = np.repeat(np.arange(len(parts), dtype=np.int64), counts)
            key, tf = np.unique((np.concatenate(parts).astype(np.int64) << 16) | doc, return_counts=True)
            word, place = key >> 16, key & 0xFFFF
            c = np.bincount(word, tf * np.array(learn)[place], len(names)).astype(np.int64)
            again = (tf + 254) // 255
            if (again > 1).any():
                rest = tf - 255 * (again - 1)
                last = np.cumsum(again) - 1
                word, place = np.repeat(word, again), np.repeat(place, again)
                tf = np.full(len(word), 255)
                tf[last] = rest
            raw = np.empty((len(word), 3), np.uint8)
            raw[:, 0], raw[:, 1], raw[:, 2] = place & 255, place >> 8, tf
            ends = np.cumsum(np.bincount(word, minlength=len(names)))
            block, n = base + number, len(names)
            table = pa.Table.from_arrays([pa.array(np.full(n, block)), pa.array(list(names), pa.binary()), pa.array(c), pa.array(np.arange(n), pa.int32()), pa.nulls(n, pa.binary())], names_of)
            yield from table.to_batches(20_000)
            known = np.array([x is not None for x in ids])
            post = np.array([len(ids), n], "<i8").tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes() + (counts + 1).astype("<i8").tobytes() + ends.astype("<i8").tobytes() + known.tobytes() + raw.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([None], pa.binary()), pa.array([sum(learn)], pa.int64()), pa.array([-1], pa.int32()), pa.array([post], pa.binary())], names_of)
            number, size = number + 1, 0
            for x in (ids, learn, parts, names):
                x.clear()

        for b in batches:
            for doc_id, text, trains in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (size + len(text) > BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                    yield from flush()
                words = text.lower().split()
                ids.append(doc_id)
                learn.append(trains)
                parts.append(np.fromiter([names.setdefault(w, len(names)) for w in words], np.int32, len(words)))
                size += len(text)
        yield from flush()

    ready(docs.sparkSession)
    return materialise(docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"), train.alias("train")).mapInArrow(run, columns), "lattice-index")


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins small batches, as numpy pays by the call."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= LOT:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def fit(counts: DataFrame, ends: int, vocabulary: tuple[list[bytes], np.ndarray] | None = None, passes: int = FIT_PASSES) -> tuple[list[bytes], np.ndarray, float]:
    """Pieces, their log probabilities, and that of the end, by expectation-maximisation over words (word, c) and `ends` ends.

    What comes back a pass is bounded by the vocabulary.
    """
    spark = counts.sparkSession
    pieces, weights = vocabulary or default_vocabulary()
    lattice = Lattice(pieces, np.log(weights / weights.sum()))
    start = np.exp(lattice.logp)
    start /= start.sum()
    lattice.logp = np.log(start)
    words = counts.where("c > 0").select("word", "c")
    end = 0.0
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((lattice.pieces, lattice.logp))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Lattice(*shared.value)
            expect = np.zeros(len(own.pieces))
            for b in lots(batches):
                own.score(b.column(0).to_pylist(), expect, b.column(1).to_numpy().astype(float))
            at = np.flatnonzero(expect)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(expect[at])], ["piece", "n"])

        found = words.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = PRIOR * start
        for r in found:
            n[r.piece] += r.n
        total = n.sum() + ends + 1
        lattice.logp, end = np.log(n / total), math.log((ends + 1) / total)
        shared.destroy()
    return lattice.pieces, lattice.logp, end


def lattice_scores(docs: DataFrame, held_out_fold: tuple[int, int] = (5, 1), vocabulary: tuple[list[bytes], np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the fold's modulus and remainder are not learned from.

    vocabulary: pieces and their weights (see default_vocabulary, piece_weights).
    """
    spark = ready(docs.sparkSession)
    modulus, rest = held_out_fold
    held = fold("doc_id", modulus) == rest
    rows = index(docs, ~held)
    counts = materialise(rows.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("c").alias("c")), "lattice-counts")
    ends = rows.where(F.col("word").isNull()).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first().n
    total = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    *model, log_end = fit(counts, ends, vocabulary)
    shared = spark.sparkContext.broadcast(model)
    n, v = total.n + ends, total.v + (ends > 0)
    below = math.log(n + 0.5 * (v + 1))
    base_end, score_end = (math.log(ends + 0.5) - below) / LOG10, log_end / LOG10

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*shared.value)
        for b in lots(batches):
            c = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c > 0), pa.array((np.log(c + 0.5) - below) / LOG10), pa.array(own.score(b.column(0).to_pylist()) / LOG10)], ["word", "known", "base", "score"])

    weighed = counts.mapInArrow(weigh, "word binary, known boolean, base double, score double")
    found = rows.where(F.col("word").isNotNull()).select("block", "word", "slot").join(weighed.hint("merge"), "word").select(F.col("block").alias("own"), "slot", "known", "base", "score")

    def gather(block: pa.Table, words: pa.Table) -> pa.Table:
        raw = block.column("post")[0].as_py()
        texts, distinct = np.frombuffer(raw, "<i8", 2).tolist()
        ids, n_tokens, stops = (np.frombuffer(raw, "<i8", k, at) for k, at in ((texts, 16), (texts, 16 + 8 * texts), (distinct, 16 + 16 * texts)))
        doc_id = pa.array(ids, mask=~np.frombuffer(raw, "?", texts, 16 + 16 * texts + 8 * distinct))
        flat = np.frombuffer(raw, np.uint8, offset=16 + 17 * texts + 8 * distinct).reshape(-1, 3)
        word = np.repeat(np.arange(distinct), np.diff(stops, prepend=0))
        place, tf = flat[:, 0].astype(np.int64) | (flat[:, 1].astype(np.int64) << 8), flat[:, 2].astype(float)
        sums, slot = [], words.column("slot").to_numpy()
        for name, own in (("known", float(ends > 0)), ("base", base_end), ("score", score_end)):
            value = np.zeros(distinct)
            value[slot] = words.column(name).to_numpy().astype(float)
            sums.append(np.bincount(place, tf * value[word], texts) + own)
        return pa.table({"doc_id": doc_id, "n_tokens": pa.array(n_tokens), "n_known": pa.array(np.rint(sums[0]).astype(np.int64)), "base_score": sums[1], "score": sums[2]})

    blocks = rows.where(F.col("word").isNull()).select("block", "post")
    out = blocks.groupBy("block").cogroup(found.groupBy("own")).applyInArrow(gather, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

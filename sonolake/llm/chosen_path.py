"""Set similarity join by chosen paths: near-duplicate documents by the Jaccard similarity of word shingles.

A document's set is its distinct shingles of five words. Equal sets are one member from here on. Minwise
hashes choose tokens of a set: two sets share the chosen one with a probability of their similarity.

A tree branches recursively: a member goes from a node to the children of the tokens chosen there, two in each node. TREES
independent trees have ROOTS first choices together. Nodes with one member end there; nodes of up to SMALL members are
compared exhaustively; larger ones branch further.

A pair of similarity 0.75 shares no first node with a chance of 0.25 ** 12 = 6e-8. If all its shared nodes branch, and branch
again without end, a pair loses one with a chance of q = (1 - 0.75 + 0.75 q) ** 2, which is 1 / 9; so at any depth the
chance to miss it is below (1 - 0.75 * 8 / 9) ** 12 = 2e-6. (One choice a node would miss 7e-4 at depth 6.)

Components need only links between what is not linked yet. So first every member of a node names its nearest other member and
the node's hub (the member near most others): among all members of a small node, among PROBES random members of a larger one,
in parts, so that no task gets a whole large node. Of these each member's best two are confirmed on full sets, and give
components. From then on only nodes with several components count, and only pairs between components: all of them in small
nodes; in a large node of one large component and FEW others, the others against all, in blocks; any other large node
branches, and at DEPTH is compared in blocks. So no pair is dropped, and a group of thousands of near copies never has
all its pairs confirmed.

A sketch of WIDTH minwise values rules out pairs that are far from similar enough, and so do exact distances from a
common hub, by the triangle inequality; all others are confirmed on full sets.

Defined results: words are in bytes with A-Z in lower case; a text with fewer than five words has one shingle of all;
a null text or one without words has none and is linked with nothing (component_id is its own id). Repeated rows have
the same result. Of different texts under one doc_id, that whose set has the smallest 128-bit name is compared with others; equal
sets always meet, under whatever id. A null doc_id takes the component of an equal set, or null, and is not kept. An empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ready, repeated, salt, text_bytes, words_of
from .components import components, extended

SHINGLE = 5
PERCENT = 75
TREES = 8
#: Members of a node that one task compares exhaustively, and members outside a large node's main component that are compared with all
#: others in blocks: a member costs at most that many comparisons a node, whatever the node's size.
SMALL = 6000
FEW = 256
DEPTH = 6
#: Members of a large node that every member is held against to find the hub, and rows of a part of a large node.
PROBES = 64
SPREAD = 1024
BLOCK = 64
WIDTH = 512
#: Common values that a pair needs to be confirmed: 4.5 standard deviations below what a similarity of 0.75 gives.
ROUGH = int(0.75 * WIDTH - 4.5 * math.sqrt(WIDTH * 0.75 * 0.25))
#: Nearest members and hubs are named from the sketch's first values alone; that many of them must be common.
LIGHT = 64
LIGHT_ROUGH = int(0.55 * LIGHT)
GOLD = np.uint64(0x9E3779B97F4A7C15)
SALTS = np.array([1, 2], np.uint64) * GOLD
_random = np.random.default_rng(20)
FACTORS = _random.integers(1, 1 << 62, WIDTH + 2 * TREES, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 1 << 62, WIDTH + 2 * TREES, np.uint64)
#: Hash functions of the trees' roots: two for every second tree, one for the others.
ROOTS = [WIDTH + 2 * t + j for t in range(TREES) for j in range(1 + t % 2)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; word hashes are kept between texts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, raw: bytes) -> np.ndarray:
        words, known, hashed = words_of(raw), self.known, xxhash.xxh3_64_intdigest
        if len(known) > 500_000:
            known.clear()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter([known[w] if w in known else known.setdefault(w, hashed(w)) for w in words], np.uint64, len(words))
        size = min(SHINGLE, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = (out ^ h[i : len(h) - size + 1 + i]) * GOLD
            out ^= out >> np.uint64(29)
        return np.unique(mix(out))


def minwise(s: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    out = np.empty(len(functions), np.uint64)
    for at in range(0, len(functions), 8):
        f = functions[at : at + 8]
        least = None
        for piece in range(0, len(s), 1 << 14):
            block = (s[None, piece : piece + (1 << 14)] * FACTORS[f, None] + SHIFTS[f, None]).min(1)
            least = block if least is None else np.minimum(least, block)
        out[at : at + 8] = least
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, mark (names the text), n_shingles, set_hi and set_lo (128 bits that name the set; null without shingles), nodes (the trees' first nodes)."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, roots = Shingler(), np.array(ROOTS)
        for b in batches:
            n, hi, lo, nodes = [], [], [], []
            for raw in b.column(2).to_pylist():
                s = shingles(raw)
                n.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes())
                hi.append(int.from_bytes(digest[:8], "little", signed=True) if len(s) else None)
                lo.append(int.from_bytes(digest[8:], "little", signed=True) if len(s) else None)
                nodes.append(mix(minwise(s, roots) + roots.astype(np.uint64) * GOLD).view(np.int64).tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], ["doc_id", "mark", "n_shingles", "set_hi", "set_lo", "nodes"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, mark long, n_shingles long, set_hi long, set_lo long, nodes array<long>")


def signed(texts: DataFrame) -> DataFrame:
    """Adds sig, WIDTH minwise values of 8 bits, to id, text, nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, every = Shingler(), np.arange(WIDTH)
        for b in batches:
            sig = [(mix(minwise(shingles(t), every)) & np.uint64(255)).astype(np.uint8).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig, pa.binary())], ["id", "text", "nodes", "sig"])

    return texts.select("id", "text", "nodes").mapInArrow(run, "id long, text binary, nodes array<long>, sig binary")


def read_signatures(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def children(node: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
    """The two children that each member goes to. Which values of the sketch a node chooses follows from its hash."""
    out = []
    for s in SALTS:
        at = mix(node ^ s) % np.uint64(WIDTH)
        out.append(mix(node * GOLD + mix((at << np.uint64(20)) | sig[np.arange(len(node)), at.astype(np.int64)])))
    return out


def next_nodes(held: DataFrame) -> DataFrame:
    """node, id of the children of every row. held: node, id, sig."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for child in children(b.column(0).to_numpy().view(np.uint64), read_signatures(b.column(2))):
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column(1)], ["node", "id"])

    return held.select("node", "id", "sig").mapInArrow(run, "node long, id long")


def parted(rows: DataFrame) -> DataFrame:
    """Adds part: about SPREAD rows of a node each. rows: id, n (the node's size)."""
    return rows.withColumn("part", salt(F.ceil(F.col("n") / SPREAD), "id"))


def by_parts(nodes: DataFrame) -> DataFrame:
    """A row for each part of each node, to meet the rows of parted(). nodes: node, n."""
    return nodes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / SPREAD) - 1)))


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, link (whether the full sets reach PERCENT) and distance (1 - similarity) of pairs. texts: id, text (binary).

    One text a pair moves; the joins merge at every size, so that a key with many pairs can be split.
    """
    one = materialise(pairs.select("a", "b").distinct(), "path-pairs")
    mine = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    held = mine.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, kept = Shingler(), None, None
        for batch in batches:
            link, distance = [], []
            for y, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if y != last:
                    last, kept = y, shingles(text_b)
                s = shingles(text_a)
                both = len(np.intersect1d(s, kept, assume_unique=True))
                union = len(s) + len(kept) - both
                link.append(100 * both >= PERCENT * union)
                distance.append(1 - both / union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(link, pa.bool_()), pa.array(distance, pa.float64())], ["a", "b", "link", "distance"])

    return materialise(held.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, link boolean, distance double"), "path-compared")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach PERCENT."""
    return compared(pairs, texts).where("link").select("a", "b")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Cuts batches that are sorted by their first column into tables of one value."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        node = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
        if held and held[0].column(0)[0].as_py() != node[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts, cuts[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def nominate(nodes: DataFrame) -> DataFrame:
    """a, b, near, hub: every member's nearest other and its node's hub. nodes: node, id, sig; small ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            ids, sig = t.column("id").to_numpy(), read_signatures(t.column("sig"), LIGHT)
            n = len(ids)
            near, other, degree, to_hub = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), None
            for i in range(n):
                c = (sig == sig[i]).sum(1)
                c[i] = -1
                other[i] = c.argmax()
                near[i] = c[other[i]]
                degree[i] = (c >= 0.75 * LIGHT).sum()
                if to_hub is None or degree[i] > degree[to_hub[0]]:
                    to_hub = i, c
            hub, c = to_hub
            a, b = np.concatenate([ids, ids]), np.concatenate([ids[other], np.full(n, ids[hub])])
            value, is_hub = np.concatenate([near, c]), np.repeat([False, True], n)
            keep = (value >= LIGHT_ROUGH) & (a != b)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(value[keep], pa.int32()), pa.array(is_hub[keep])], ["a", "b", "near", "hub"])

    return nodes.select("node", "id", "sig").repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a long, b long, near int, hub boolean")


def nominate_large(nodes: DataFrame) -> DataFrame:
    """As nominate, of large nodes: nearest and hub by PROBES random members. nodes: node, id, n, sig."""
    rows = materialise(parted(nodes.select("node", "id", "n", "sig")), "path-large")
    pair = F.struct("id", "sig")
    chosen = rows.where(F.pmod(F.xxhash64("id", "node"), F.ceil(F.col("n") / PROBES)) == 0)
    probes = by_parts(chosen.groupBy("node").agg(F.first("n").alias("n"), F.collect_list(pair).alias("probes"))).drop("n")
    met = rows.groupBy("node", "part").agg(F.collect_list(pair).alias("mine")).join(probes.hint("merge"), ["node", "part"]).select("node", "mine", "probes")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, mine, others in zip(*b.columns, strict=True):
                (ids, sig), (ids2, sig2) = ((x.values.field("id").to_numpy(), read_signatures(x.values.field("sig"), LIGHT)) for x in (mine, others))
                alike = np.stack([(sig == s).sum(1) for s in sig2], 1)
                alike[ids[:, None] == ids2[None, :]] = -1
                best = alike.argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), node.as_py())), pa.array(ids), pa.array(ids2[best]), pa.array(alike.max(1).astype(np.int32)), pa.array((alike >= 0.75 * LIGHT).sum(1))], ["node", "a", "b", "near", "degree"])

    seen = materialise(met.mapInArrow(near, "node long, a long, b long, near int, degree long"), "path-probed")
    hubs = seen.groupBy("node").agg(F.max(F.struct("degree", F.col("a").alias("id"))).alias("m")).select("node", F.col("m.id").alias("hub"))
    hubs = hubs.join(rows.select("node", F.col("id").alias("hub"), "n", F.col("sig").alias("hub_sig")), ["node", "hub"])
    held = rows.join(by_parts(hubs).drop("n").hint("merge"), ["node", "part"]).where("id <> hub").select("id", "hub", "sig", "hub_sig")

    def to_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = (read_signatures(b.column(2), LIGHT) == read_signatures(b.column(3), LIGHT)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alike.astype(np.int32)), pa.array(np.full(b.num_rows, True))], ["a", "b", "near", "hub"])

    both = seen.select("a", "b", "near", F.lit(False).alias("hub")).unionAll(held.mapInArrow(to_hub, "a long, b long, near int, hub boolean"))
    return both.where(F.col("near") >= LIGHT_ROUGH)


def apart(hub: np.ndarray, far: np.ndarray, other_hub: np.ndarray, other_far: np.ndarray) -> np.ndarray:
    """Pairs that cannot reach PERCENT: Jaccard distance is a metric, so two members of a hub are at least the
    difference of their distances from it apart. Members without a hub have their own id and distance 0."""
    return (hub == other_hub) & (np.abs(far - other_far) > 1 - PERCENT / 100 + 1e-9)


def exhaustive(rows: DataFrame) -> DataFrame:
    """a, b: likely pairs of different components in each small node. rows: node, id, comp, sig, nodes, hub, far.

    A pair that shares several of the trees' small first nodes comes from the first of them only; large ones are masked
    in nodes, as a pair that shares them may not meet there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            ids, comp, sig = t.column("id").to_numpy(), t.column("comp").to_numpy(), read_signatures(t.column("sig"))
            first, hub, far = np.array(t.column("nodes").to_pylist()), t.column("hub").to_numpy(), t.column("far").to_numpy()
            here = first[0] == t.column("node")[0].as_py()
            before = first[:, : int(here.argmax())] if here.any() else first[:, :0]
            for i in range(len(ids) - 1):
                other = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
                other = other[~apart(hub[other], far[other], hub[i], far[i])]
                other = other[(sig[other] == sig[i]).sum(1) >= ROUGH]
                other = other[~(before[other] == before[i]).any(1)]
                if len(other):
                    x = np.full(len(other), ids[i])
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, ids[other])), pa.array(np.minimum(x, ids[other]))], ["a", "b"])

    return rows.select("node", "id", "comp", "sig", "nodes", "hub", "far").repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a long, b long")


def blocks(rows: DataFrame, size: Column, name: str, *keys: str) -> DataFrame:
    """keys and blocks of about BLOCK rows, as arrays of id, comp, sig, hub, far, with n (the node's size). size: how many rows the keys have."""
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(size / BLOCK)).alias("block")
    return rows.groupBy(*keys, block).agg(F.collect_list(F.struct("id", "comp", "sig", "hub", "far")).alias(name), F.first("n").alias("n")).drop("block")


def block_pairs(all_blocks: DataFrame, other_blocks: DataFrame) -> DataFrame:
    """a, b: likely pairs of different components between the blocks (mine by node and part, theirs by node)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for mine, theirs in zip(b.column(0), b.column(1), strict=True):
                (ids, comp, hub, far, sig), (ids2, comp2, hub2, far2, sig2) = ((*(x.values.field(c).to_numpy() for c in ("id", "comp", "hub", "far")), read_signatures(x.values.field("sig"))) for x in (mine, theirs))
                for i in range(len(ids2)):
                    keep = ((sig == sig2[i]).sum(1) >= ROUGH) & (comp != comp2[i]) & ~apart(hub, far, hub2[i], far2[i])
                    if keep.any():
                        x = np.full(int(keep.sum()), ids2[i])
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, ids[keep])), pa.array(np.minimum(x, ids[keep]))], ["a", "b"])

    met = all_blocks.drop("n").join(by_parts(other_blocks).drop("n").hint("merge"), ["node", "part"]).select("mine", "theirs")
    return met.mapInArrow(run, "a long, b long")


def linked(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], small: int = SMALL, few: int = FEW, depth: int = DEPTH) -> DataFrame:
    """id, component of all members that PERCENT similarity links to others. members: id, nodes; distinct sets.

    texts_of gets rows of id and gives id, text of those.
    """
    held = materialise(repeated(members.select("id", F.explode("nodes").alias("node")), ["node"], ["id"]), "path-nodes")
    large_of = held.groupBy("id").agg(F.collect_set(F.when(F.col("n") > small, F.col("node"))).alias("large"))
    masked = F.transform("nodes", lambda x, i: F.when(F.array_contains("large", x), F.xxhash64("id", i)).otherwise(x))
    some = members.join(large_of, "id").select("id", masked.alias("nodes"))
    texts = materialise(signed(texts_of(some.select("id")).join(some, "id")), "path-texts")
    sigs = texts.select("id", "sig", "nodes")
    light = texts.select("id", F.substring("sig", 1, LIGHT).alias("sig")).hint("merge")

    near = nominate(held.where(F.col("n") <= small).join(light, "id"))
    if not held.where(F.col("n") > small).isEmpty():
        near = near.unionAll(nominate_large(held.where(F.col("n") > small).join(light, "id")))
    best = near.groupBy("a", "hub").agg(F.max(F.struct("near", "b")).alias("m")).select("a", "hub", F.col("m.b").alias("b"))
    both = materialise(best, "path-nominated")
    seen = compared(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), texts)
    label = components(seen.where("link"))
    ways = seen.select("a", "b", "distance").unionAll(seen.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    hubs = both.where("hub").groupBy("a").agg(F.min("b").alias("b")).join(ways, ["a", "b"]).groupBy("a", "b").agg(F.min("distance").alias("far")).select(F.col("a").alias("id"), F.col("b").alias("hub"), "far")
    hubs = materialise(hubs, "path-hubs")
    now = held
    for level in range(1, depth + 1):
        comps = materialise(parted(now).join(label, "id", "left").select("node", "part", "id", "n", F.coalesce("component", "id").alias("comp")), "path-comps")
        mixed = comps.groupBy("node").agg(F.first("n").alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("node", "n")
        rows = materialise(comps.join(by_parts(mixed).drop("n").hint("merge"), ["node", "part"]), "path-mixed")
        if rows.isEmpty():
            break
        rows = rows.join(hubs, "id", "left").withColumns({"hub": F.coalesce("hub", "id"), "far": F.coalesce("far", F.lit(0.0))})
        pairs = exhaustive(rows.where(F.col("n") <= small).join(sigs.hint("merge"), "id"))
        large = rows.where(F.col("n") > small)
        deeper = large.isEmpty()
        if not deeper:
            sizes = large.groupBy("node", "comp").agg(F.count("*").alias("k"), F.first("n").alias("n")).groupBy("node").agg(F.max(F.struct("k", "comp")).alias("m"), F.first("n").alias("n"))
            main = materialise(sizes.select("node", "n", F.col("m.comp").alias("main"), (F.col("n") - F.col("m.k")).alias("others")), "path-main")
            done = main.where(F.col("others") <= few) if level < depth else main
            mine = large.join(by_parts(done).drop("n").hint("merge"), ["node", "part"]).join(sigs.select("id", "sig"), "id")
            theirs = mine.where("comp <> main")
            pairs = pairs.unionAll(block_pairs(blocks(mine, F.least("n", F.lit(SPREAD)), "mine", "node", "part"), blocks(theirs, F.col("others"), "theirs", "node")))
        label = extended(label, confirmed(pairs, texts))
        if deeper or level == depth:
            break
        left = large.join(by_parts(main.where(F.col("others") > few)).select("node", "part").hint("merge"), ["node", "part"])
        child = materialise(next_nodes(left.join(sigs.select("id", "sig"), "id")), "path-children")
        now = repeated(child, ["node"], ["id"])
    return label


def near_duplicates(docs: DataFrame, small: int = SMALL, few: int = FEW, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is that one), mark (xxhash64 of the text)."""
    ready(docs.sparkSession)
    sketch = materialise(sketches(docs), "path-sketches")
    named = repeated(sketch, ["set_hi", "set_lo"], ["doc_id", "mark"], least="doc_id", every=True)
    named = materialise(named.withColumn("id", F.when(F.col("set_hi").isNotNull(), F.coalesce("least", "doc_id"))).drop("n", "least"), "path-sets")
    chosen = named.where("doc_id = id").groupBy("id").agg(F.min(F.struct("set_hi", "set_lo", "mark", "nodes")).alias("m"))
    members = materialise(chosen.select("id", "m.mark", "m.nodes"), "path-members")

    def texts_of(ids: DataFrame) -> DataFrame:
        every = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"), text_bytes().alias("text"))
        return every.join(members.select("id", "mark").join(ids, "id").hint("merge"), ["id", "mark"]).select("id", "text").dropDuplicates(["id"])

    label = linked(members.select("id", "nodes"), texts_of, small, few, depth)
    own = F.coalesce("component", "id", "doc_id")
    return named.join(label, "id", "left").select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"), "mark")

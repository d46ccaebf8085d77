"""Removal of line passages that repeat across the corpus, by content-defined chunks, in DataFrame expressions only.

A hash is rolled over the lines' hashes with a window of two lines, one value a pair of neighbouring lines:

    r[i] = 2 * h[i - 1] xor h[i]

Boundaries follow from these values alone, so that a passage is cut alike wherever it stands:

- between two lines whose value occurs nowhere else, a text is always cut: what is left are its stretches;
- a stretch is cut further in CUTTINGS ways. One keeps stretches whole; one cuts where the number of occurrences of the
  rolled value changes, as other texts hold just one side of such a place; the others cut where the window before the place, or
  the window after it, has a residue of its own digits of the value (mean chunk MEAN lines). A stretch may hold
  more than what a second text shares; the residues then cut both texts alike inside what they share.

Chunks of two lines or more whose bytes occur elsewhere are removed, but for the first occurrence (smallest doc_id, then
place). Equal hashes only nominate chunks: what counts is the chunk's bytes. The earliest copy of a line is never removed.

All joins merge sorted sides, so that small inputs run as large ones do and AQE can split a hot key's partitions; rolled values
and chunk hashes are counted in salted cells.

Defined results: a null text stays null, an empty one empty, and neither is removed. Lines end at \\n. A chunk with no
word does not count. Repeated rows of one doc_id with the same text are one document, and keep or lose the same lines.
A null doc_id sorts first. An empty table gives no rows. Extra columns pass through unchanged, whatever their names; remove()
adds removed_lines and removed_chunks, and replaces columns of these names; cleaned() adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, repeated, unused

#: Cuttings by residues; each takes 3 bits of the rolled value for windows before a place and 3 for windows after it.
SEEDS = 10
#: Residues of 8 that cut, so that a place is cut with a chance of 1 - (5 / 8) ** 2, and a chunk has MEAN lines.
RESIDUES = 3
MEAN = 1 / (1 - (1 - RESIDUES / 8) ** 2)
#: Whole stretches, changes of the count, and the seeds.
CUTTINGS = SEEDS + 2
#: Bits of a rolled value.
BITS = 6 * SEEDS


def line_hash(line: Column) -> Column:
    """The first BITS bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def rolled(lines: Column) -> Column:
    """at (the later line's place) and key (rolled value) of each pair of neighbouring lines."""
    mask = F.lit((1 << BITS) - 1)
    h = F.transform(lines, line_hash)
    pairs = F.arrays_zip(F.slice(h, 1, F.size(h) - 1).alias("a"), F.slice(h, 2, F.size(h) - 1).alias("b"))
    return F.transform(pairs, lambda p, i: F.struct((i + 1).alias("at"), F.shiftleft(p["a"], 1).bitwiseAND(mask).bitwiseXOR(p["b"]).alias("key")))


def hits(key: Column, seed: int, after: bool) -> Column:
    return F.shiftright(key, 3 * seed + 3 * SEEDS * after).bitwiseAND(F.lit(7)) < RESIDUES


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, mark (names the text), at, key of every pair of neighbouring lines."""
    lines = docs.where(F.instr("text", "\n") > 0).select("doc_id", F.xxhash64("text").alias("mark"), F.split("text", "\n", -1).alias("lines"))
    return lines.select("doc_id", "mark", F.explode(rolled(F.col("lines"))).alias("r")).select("doc_id", "mark", "r.*")


def chunks(found: DataFrame) -> DataFrame:
    """doc_id, mark, at, size, key of the chunks of all cuttings, each range once. found: doc_id, mark, at, key, n of windows that repeat."""
    text = Window.partitionBy("doc_id", "mark").orderBy("at")
    no = F.lit(False)
    near = found.select("doc_id", "mark", "at", "key", "n").distinct().select(
        "*", F.coalesce(F.lag("at").over(text) == F.col("at") - 1, no).alias("linked"), F.lag("key").over(text).alias("before"), F.lag("n").over(text).alias("n_before"),
        F.coalesce(F.lead("at").over(text) == F.col("at") + 1, no).alias("followed"), F.lead("key").over(text).alias("after"),
    )

    def straddles(seed: int) -> Column:
        """Whether the seed cuts between this window's lines: the window is not kept then."""
        return (F.col("linked") & F.coalesce(hits(F.col("before"), seed, False), no)) | (F.col("followed") & F.coalesce(hits(F.col("after"), seed, True), no))

    ways = [(F.lit(True), F.col("linked")), (F.lit(True), F.col("linked") & (F.col("n") == F.col("n_before")))] + [(~straddles(s), F.col("linked")) for s in range(SEEDS)]
    each = near.select("doc_id", "mark", "at", "key", F.explode(F.array(*(F.struct(F.lit(i).alias("way"), k.alias("kept"), F.coalesce(j, no).alias("joined")) for i, (k, j) in enumerate(ways)))).alias("w"))
    cut = Window.partitionBy("doc_id", "mark", "way").orderBy("at")
    begins = ~(F.col("joined") & F.coalesce(F.lag("at").over(cut) == F.col("at") - 1, no))
    runs = each.where("w.kept").select("doc_id", "mark", "at", "key", F.col("w.way").alias("way"), F.col("w.joined").alias("joined")).withColumn("begins", begins).withColumn("run", F.count_if("begins").over(cut))
    ranges = runs.groupBy("doc_id", "mark", "way", "run").agg((F.min("at") - 1).alias("at"), (F.max("at") - F.min("at") + 2).alias("size"), F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct(F.col("at").alias("i"), "key"))), lambda x: x["key"])).alias("key"))
    return ranges.select("doc_id", "mark", "at", "size", "key").distinct()


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, mark, at, size of every chunk that repeats an earlier one byte by byte.

    Rolled values and hashes of chunks meet first, without text; only texts that hold a chunk hash seen twice give their chunks' bytes.
    """
    place = F.struct("doc_id", "mark", "at")
    found = repeated(materialise(windows(docs), "line-windows"), ["key"], ["doc_id", "mark", "at"])
    every = materialise(chunks(found), "chunk-hashes")
    wanted = repeated(every, ["key"], ["doc_id", "mark", "at"]).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "size", "key")).alias("wanted"))
    wanted = materialise(wanted.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), "wanted"), "chunk-wanted")
    texts = docs.where(F.instr("text", "\n") > 0).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    held = texts.join(wanted.hint("merge"), (F.col("mark") == F.col("__mark")) & F.col("doc_id").eqNullSafe(F.col("__doc")))
    lines = F.split("text", "\n", -1)
    bodies = F.transform("wanted", lambda r: F.struct(r["at"].alias("at"), r["size"].alias("size"), r["key"].alias("key"), F.array_join(F.slice(lines, r["at"] + 1, r["size"]), "\n").alias("body")))
    held = held.select("doc_id", "mark", F.explode(bodies).alias("r")).select("doc_id", "mark", "r.*")
    held = materialise(held.where(F.col("body").rlike(r"[^\x20\x09-\x0D]")), "chunk-bodies")
    first = materialise(held.groupBy("key", "body").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("key", "body", "first"), "chunk-first")
    return held.join(first.hint("merge"), ["key", "body"]).where(place != F.col("first")).select("doc_id", "mark", "at", "size")


def removed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the repeated lines removed from text, and the names of two more columns: the lines and the chunks removed."""
    doc, mark, gone, n, lines, found = unused(docs.columns, "doc", "mark", "gone", "ranges_n", "lost_lines", "lost_chunks")
    ranges = repeats(docs).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "size")).alias("ranges"))
    places = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["at"], r["at"] + r["size"] - 1))))
    ranges = materialise(ranges.select(F.col("doc_id").alias(doc), F.col("mark").alias(mark), places.alias(gone), F.size("ranges").alias(n)), "chunk-ranges")
    met = docs.join(ranges.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(mark)), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)
    lost = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    return met.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), lost.alias(lines), F.coalesce(n, F.lit(0)).alias(found)), lines, found


def remove(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines removed from text, and the columns removed_lines and removed_chunks."""
    out, lines, found = removed(docs)
    kept = [c for c in docs.columns if c not in ("removed_lines", "removed_chunks")]
    return out.select(*kept, F.col(lines).alias("removed_lines"), F.col(found).alias("removed_chunks"))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines removed from text, in the columns of docs; a document that loses lines and has no word left goes."""
    out, lines, _ = removed(docs)
    return out.where((F.col(lines) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)

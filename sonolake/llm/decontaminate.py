"""Benchmark decontamination by spaced seeds, in DataFrame expressions only.

A mask names the places of a window of words that are hashed; the others may differ, so that a substituted
word breaks the masks that look at it and no other. Windows of test items and of training texts with equal
hashes are hits. The last mask ignores every fourth place, so that a passage with every fourth word substituted is found too.

Around a hit, item and text are compared word by word on the hit's diagonal, REACH words to either side; the overlap counts if at least
MIN_MATCH words agree (all, for shorter items) and 3 of 4 of those compared.

Items' windows are broadcast while they are few (counted first); beyond that, windows of both sides meet in a
shuffle, dealt by hash and salt, and only hits fetch the words around them.

Defined results: words are runs of letters and digits, in lower case. Null and empty texts have no words and match
nothing; items of fewer than FEWEST words cannot be told from chance and match nothing; items shorter than the masks
must occur whole. A null id is reported as null. Repeated rows of one id are one document for contaminated(), repeated items
of one id one item; clean() judges each text by itself, rows without an id among them. Empty tables give no rows; extra
columns are not read, and clean() returns them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salt, unused

#: 1: the word is hashed. Fixed; every pair of substituted words spares at least one of them somewhere in a passage.
MASKS = ["110110101", "101011011", "111011101"]
SPAN = 9
REACH = 8
MIN_MATCH = 13
FEWEST = 5
BROADCAST_WORDS = 50_000
#: Copies of the items' windows that training windows are dealt to in the shuffled plan.
COPIES = 16
#: Places of a segment, and words of the window around a hit.
STEP = 16
WINDOW = SPAN + 2 * REACH


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.xxhash64(w))


def offsets(k: int) -> list[int]:
    """Hashed places of pattern k: the masks, then the whole windows of short items."""
    return [i for i, c in enumerate(MASKS[k]) if c == "1"] if k < len(MASKS) else list(range(FEWEST + k - len(MASKS)))


def span(k: int) -> int:
    return SPAN if k < len(MASKS) else FEWEST + k - len(MASKS)


def padded(h: Column) -> Column:
    """REACH nulls before the words, so that a window is a slice at its hit's place."""
    return F.concat(F.array_repeat(F.lit(None).cast("long"), REACH), h)


def segments(rows: DataFrame) -> DataFrame:
    """Explodes h into pieces of STEP places each: base, seg (the words of these places and all that a hit there looks at).

    A piece is short, so that the hits of a long text are not held at once. Texts of fewer than FEWEST words have no pieces; a filter on
    their size would be pushed below the words and find them a second time.
    """
    size = F.size("p") - REACH
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(STEP))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("base"), F.slice("p", s + 1, STEP + WINDOW - 1).alias("seg")))
    return rows.withColumn("p", padded(F.col("h"))).withColumn("s", F.explode(F.when(size >= FEWEST, pieces))).drop("h", "p").withColumns({"base": F.col("s.base"), "seg": F.col("s.seg")}).drop("s")


def seeds(rows: DataFrame, patterns: list[int]) -> DataFrame:
    """Explodes segments into key and place (in seg) of each window and pattern; a text's last windows lack words and have none.

    Places are exploded first and the hashes written out for one of them: that is little code, without lambdas, so that both explosions and
    a join with broadcast windows are one compiled loop, which copies no segment for a key that is not found.
    """
    keys = []
    for k in patterns:
        # nulls before and after the text are not hashed, so the rims are tested
        at = lambda o: F.get("seg", F.col("place") + (REACH + o))
        keys.append(F.when(at(0).isNotNull() & at(span(k) - 1).isNotNull(), F.xxhash64(F.lit(k), *map(at, offsets(k)))))
    places = rows.select(*rows.columns, F.explode(F.sequence(F.lit(0), F.lit(STEP - 1))).alias("place"))
    number = F.array(*map(F.lit, patterns))
    return places.select(*places.columns, F.posexplode(F.array(*keys)).alias("n", "key")).where("key is not null").withColumn("pattern", F.get(number, F.col("n"))).drop("n")


def window(seg: Column, place: Column) -> Column:
    return F.slice(seg, place + 1, WINDOW)


def overlaps(docs: DataFrame, items: DataFrame, keys: list[str], broadcast_words: int) -> DataFrame:
    """keys, item_id, matched (most words that agree), identity (best share) of every overlap. docs: keys and h (words' hashes)."""
    test = items.select("item_id", word_hashes(F.col("text")).alias("h")).withColumn("size", F.size("h"))
    sizes = test.where(F.col("size") >= FEWEST).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.collect_set(F.when(F.col("size") < SPAN, F.col("size"))).alias("short")).first()
    patterns = [*range(len(MASKS)), *sorted(len(MASKS) + n - FEWEST for n in sizes.short)]
    span_of = F.create_map(*(F.lit(x) for k in patterns for x in (k, span(k))))[F.col("pattern")]
    # equal windows of one item judge alike; the compiled join holds all hits of a segment at once
    known = seeds(segments(test), patterns).where((F.col("pattern") < len(MASKS)) | (span_of == F.col("size"))).select("item_id", "size", "key", window(F.col("seg"), F.col("place")).alias("g")).distinct()
    if sizes.words <= broadcast_words:
        hits = seeds(segments(docs), patterns).select(*keys, "seg", "place", "key").join(F.broadcast(known), "key")
        # exploded, so that the comparison is not pushed into the join: it has lambdas, with which a join is not compiled
        hits = hits.select(*keys, "item_id", "size", "g", F.explode(F.array(window(F.col("seg"), F.col("place")))).alias("w"))
    else:
        at = seeds(segments(docs), patterns).select(*keys, (F.col("base") + F.col("place")).alias("pos"), "key").withColumn("copy", salt(COPIES, *keys, "pos"))
        copies = known.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long"))))
        met = at.join(copies.hint("merge"), ["key", "copy"]).select(*keys, "pos", "item_id", "size", "g").distinct()
        texts = docs.select(*(F.col(k).alias(f"{k}_") for k in keys), padded(F.col("h")).alias("p")).hint("merge")
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
        hits = met.join(texts, same).select(*keys, "item_id", "size", "g", window(F.col("p"), F.col("pos")).alias("w"))
    agree = F.zip_with("g", "w", lambda x, y: F.when(x == y, 1).otherwise(F.when(x.isNotNull() & y.isNotNull(), 0)))
    seen = hits.select(*keys, "item_id", "size", agree.alias("agree"))
    seen = seen.select(*keys, "item_id", "size", F.size(F.filter("agree", lambda v: v.isNotNull())).alias("compared"), F.size(F.filter("agree", lambda v: v == 1)).alias("matched"))
    good = seen.where((F.col("matched") >= F.least(F.lit(MIN_MATCH), F.col("size"))) & (4 * F.col("matched") >= 3 * F.col("compared")))
    return good.groupBy(*keys, "item_id").agg(F.max("matched").alias("matched"), F.max(F.col("matched") / F.col("compared")).alias("identity"))


def contaminated(docs: DataFrame, items: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, item_id, matched (most words that agree), identity (best share) of every overlap."""
    return overlaps(docs.select("doc_id", word_hashes(F.col("text")).alias("h")), items, ["doc_id"], broadcast_words)


def clean(docs: DataFrame, items: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of docs whose text overlaps with no item, all columns."""
    doc, mark = unused(docs.columns, "doc", "mark")
    named = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("mark"), word_hashes(F.col("text")).alias("h"))
    bad = overlaps(named, items, ["doc", "mark"], broadcast_words).select(F.col("doc").alias(doc), F.col("mark").alias(mark)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(mark)), "left_anti")

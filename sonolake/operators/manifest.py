"""Training-set building: evidence of rips, labels, caps, splits, weights and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CHECKED_SOURCE, CHECKED_STATUS, RIPPERS

HEAD_BYTES = 2048
#: Fixed value: a checked track's line: number, file, status.
TRACK = r"\d+\s*-=-\s*([^\r\n]+\.(?:flac|FLAC))\s*-=-\s*([^\r\n]+)"
#: Hash ranges of a class whose rows are ranked together.
RANGES = 4096


def ripper(head: Column) -> Column:
    """The first ripping program whose mark is in the head of a log; null without one."""
    marked = lambda marks: reduce(lambda a, b: a | b, (head.contains(m) for m in marks))
    return reduce(lambda rest, r: F.when(marked(r[1]), r[0]).otherwise(rest), reversed(RIPPERS), F.lit(None).cast("string"))


def rank(source: Column) -> Column:
    return reduce(lambda rest, x: F.when(source == x[1][0], x[0]).otherwise(rest), enumerate(RIPPERS), F.lit(len(RIPPERS)))


def log_head(content: Column) -> Column:
    """Text of a log's first bytes: UTF-16 if a zero byte is among the first 200, else UTF-8."""
    head = F.substring(content, 1, HEAD_BYTES)
    wide = F.regexp_like(F.hex(F.substring(content, 1, 200)), F.lit("^(..)*00"))
    return F.when(wide, F.decode(head, "UTF-16")).otherwise(F.decode(head, "UTF-8"))


def tracks(logs: DataFrame) -> DataFrame:
    """A row for each track line of a log's text: file and status. logs: log_path, text."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(TRACK), F.lit(1)).alias("file"), F.regexp_extract_all("text", F.lit(TRACK), F.lit(2)).alias("status"))
    return logs.withColumn("t", F.explode(both)).select(*(c for c in logs.columns if c != "text"), F.col("t.file").alias("file"), F.trim("t.status").alias("status"))


def authenticated(found: DataFrame, files: DataFrame) -> DataFrame:
    """Tracks whose status says CDDA (100%) and whose file exists beside the log. files: path."""
    path = F.concat(F.regexp_replace("log_path", "[^/]*$", ""), F.col("file"))
    return found.where(F.col("status").contains(CHECKED_STATUS)).withColumn("path", path).join(files.select("path"), "path", "left_semi")


def subtree(logs: DataFrame, files: DataFrame) -> DataFrame:
    """Every file in the folder of a log or below it. Each file's folders are exploded, so that it is an equi-join."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = files.where(F.lower("path").endswith(".flac")).select("path", F.explode(folders).alias("folder"))
    return logs.withColumn("folder", F.regexp_replace("log_path", "/[^/]*$", "")).join(above, "folder").drop("folder")


def collect(logs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """path, source, ripper, top_label of every file that a log vouches for, a row for each log that does: checked tracks of
    Audiochecker logs, and all files below the folder of the others. logs: log_path, text, ripper (null: not known, left out); files: path."""
    label = top_label(F.col("log_path"), root).alias("top_label")
    checked = authenticated(tracks(logs.where("ripper = 'Audiochecker'")), files).select("path", F.lit(CHECKED_SOURCE).alias("source"), "ripper", label)
    below = subtree(logs.where("ripper <> 'Audiochecker'").select("log_path", "ripper"), files).select("path", F.lower("ripper").alias("source"), "ripper", label)
    return checked.unionAll(below)


def top_label(path: Column, root: str) -> Column:
    """The first two components below the root; unknown outside it."""
    start = root.rstrip("/") + "/"
    return F.when(path.startswith(start), F.array_join(F.slice(F.split(F.substring(path, len(start) + 1, 1 << 30), "/"), 1, 2), "/")).otherwise("unknown")


def best_evidence(entries: DataFrame, key: str = "path") -> DataFrame:
    """One entry a key: the best source, the first seen on ties. entries: key, source, seq. Entries merge before the shuffle."""
    return entries.groupBy(key).agg(F.min_by(F.struct("*"), F.struct(rank(F.col("source")), F.col("seq"))).alias("e")).select("e.*")


def cap(entries: DataFrame, label: str, most: int, order: Column, tie: str) -> DataFrame:
    """At most `most` entries a label, chosen by the given pseudo-random order."""
    w = Window.partitionBy(label).orderBy(order, tie)
    return entries.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def top_labels(entries: DataFrame, label: str, most: int = 20) -> DataFrame:
    return entries.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(most)


def stratified_split(rows: DataFrame, y: str, order: Column, tie: str, share: float = 0.15, width: int = 1 << 20) -> DataFrame:
    """Adds split: test, val or train, with round(share * n) rows of each class in the first two, by the order (a number from 0).

    A class may hold half of all rows: rows are counted in RANGES ranges of the order (which is below width), what lies before each
    range is summed up over these counts, and rows are ranked inside their range only.
    """
    placed = rows.withColumns({"__order": order, "__range": F.floor(order * RANGES / width)})
    counts = placed.groupBy(y, "__range").agg(F.count("*").alias("__n"))
    every = Window.partitionBy(y)
    before = every.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(F.col(y).alias("__y"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.bround(share * F.sum("__n").over(every)).alias("__part"))
    met = placed.join(sums, F.col(y).eqNullSafe(F.col("__y")) & (F.col("__range") == F.col("__r")))
    at = F.col("__before") + F.row_number().over(Window.partitionBy(y, "__range").orderBy("__order", tie))
    split = F.when(at <= F.col("__part"), "test").when(at <= 2 * F.col("__part"), "val").otherwise("train")
    return met.select(*rows.columns, split.alias("split"))


def class_weights(rows: DataFrame, y: str) -> DataFrame:
    return rows.groupBy(y).agg((1 / F.count("*")).alias("weight"))


def metrics(rows: DataFrame, y: str, pred: str) -> DataFrame:
    """Confusion counts and what follows from them; empty denominators count as 1."""
    t, p = F.col(y) == 1, F.col(pred) == 1
    one = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    part = lambda a, b: a / F.greatest(b, F.lit(1))
    a = one.withColumns({"accuracy": part(tp + tn, tp + fp + fn + tn), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "specificity": part(tn, tn + fp)})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))
    return a.withColumns({"f1": f1, "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2})


def focal_loss(p_true: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    return F.avg(-alpha * F.pow(1 - p_true, F.lit(gamma)) * F.log(p_true))


def transcode_label(path: Column) -> tuple[Column, Column]:
    """(codec or null, y): files below transcoded/<codec>/ are 1, all others 0."""
    codec = F.nullif(F.regexp_extract(path, r"(?:^|/)transcoded/([^/]+)/", 1), F.lit(""))
    return codec, F.when(codec.isNotNull(), 1).otherwise(0)


def uniform(*by: Column | str) -> Column:
    """A pseudo-random number in [0, 1) from values."""
    return F.shiftrightunsigned(F.xxhash64(*by), 11) / float(1 << 53)


def beta_weight(alpha: float, *by: Column | str, tries: int = 64) -> Column:
    """A pseudo-random weight of the Beta(alpha, alpha) distribution, by rejection: of pairs u ** (1 / alpha), v ** (1 / alpha) the first whose sum is at most 1."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.struct(F.pow(uniform(*by, i, F.lit("u")), F.lit(1 / alpha)).alias("x"), F.pow(uniform(*by, i, F.lit("v")), F.lit(1 / alpha)).alias("y")))
    good = F.filter(pairs, lambda p: (p["x"] + p["y"] <= 1) & (p["x"] + p["y"] > 0))
    return F.coalesce(F.get(F.transform(good, lambda p: p["x"] / (p["x"] + p["y"])), F.lit(0)), F.lit(0.5))


def mixup(rows: DataFrame, key: str, weight: Column, order: Column, width: int, per_range: int = 1000) -> DataFrame:
    """Each row's samples mixed with another's: weight * x + (1 - weight) * x of the next row in a shuffled ring; adds mixed and partner.

    order is a pseudo-random number from 0 to width - 1. The ring runs through ranges of the order, sized for about per_range rows, so that no
    task sees all rows; the last row of a range goes on with the first of the next range that has rows. Only a single row is mixed with itself.
    """
    ranges = max(1, rows.count() // per_range)
    placed = rows.withColumns({"__order": order, "__range": F.floor(order * ranges / width)})
    first = placed.groupBy("__range").agg(F.min_by(F.struct(key, "samples"), F.struct("__order", key)).alias("__first"))
    around = Window.orderBy("__range")
    near = first.select("__range").select("__range", F.coalesce(F.lead("__range").over(around), F.min("__range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__next"))
    link = near.join(first.select(F.col("__range").alias("__next"), "__first"), "__next").drop("__next")
    inside = Window.partitionBy("__range").orderBy("__order", key)
    met = placed.withColumn("__lead", F.lead(F.struct(key, "samples")).over(inside)).join(link, "__range")
    other = F.coalesce("__lead", "__first")
    out = met.withColumn("__other", other).withColumns({"mixed": F.zip_with("samples", "__other.samples", lambda a, b: weight * a + (1 - weight) * b), "partner": F.col(f"__other.{key}")})
    return out.select(*rows.columns, "mixed", "partner")


def spec_augment(grid: Column, bands: list[tuple[Column, Column]], frames: list[tuple[Column, Column]], value: float = -1.0) -> Column:
    """Masks (start, size) on both axes of a spectrum (an array of bands, each an array of frames)."""
    hit = lambda i, masks: reduce(lambda a, b: a | b, ((i >= s) & (i < s + n) for s, n in masks), F.lit(False))
    return F.transform(grid, lambda band, i: F.transform(band, lambda v, j: F.when(hit(i, bands) | hit(j, frames), value).otherwise(v)))


def random_masks(size: int, most: int, count: int, *by: Column | str) -> list[tuple[Column, Column]]:
    """count masks of up to `most` places on an axis of a size, pseudo-random by values."""
    out = []
    for k in range(count):
        n = F.floor(uniform(*by, F.lit(f"size {k}")) * (most + 1))
        out.append((F.floor(uniform(*by, F.lit(f"start {k}")) * F.greatest(size - n, F.lit(1))), n))
    return out


def mask_bands(samples: Column, start: Column, size: Column, value: float = -1.0) -> Column:
    """Sets size places from start to a value, as spectrogram augmentation does with bands and frames."""
    return F.transform(samples, lambda v, i: F.when((i >= start) & (i < start + size), value).otherwise(v))

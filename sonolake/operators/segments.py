"""Which parts of a recording are decoded for which analysis: plans as rows, made without audio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spectrum_plan(files: DataFrame, sample_seconds: float = 30.0) -> DataFrame:
    """Three evenly spread segments of files over 90 s, one centred segment of others. files: duration, rate.

    Adds seg, start and frames (both in frames, truncated).
    """
    d = F.col("duration")
    n = F.when(d > 90, 3).otherwise(1)
    a = files.withColumn("seg", F.explode(F.sequence(F.lit(0), n - 1)))
    length = F.least(F.lit(float(sample_seconds)), d / n)
    start = F.greatest(F.lit(0.0), d / (n + 1) * (F.col("seg") + 1) - length / 2)
    return a.withColumns({"start": (start * F.col("rate")).cast("long"), "frames": (length * F.col("rate")).cast("long")})


def consistency_plan(files: DataFrame, positions: list[float], seconds: float = 10.0) -> DataFrame:
    """Segments centred at shares of the duration, kept inside the file."""
    d = F.col("duration")
    a = files.withColumn("position", F.explode(F.array(*map(F.lit, positions))))
    start = F.greatest(F.lit(0.0), F.least(d * F.col("position") - seconds / 2, d - seconds))
    return a.withColumns({"start": (start * F.col("rate")).cast("long"), "frames": (F.least(F.lit(seconds), d) * F.col("rate")).cast("long")})


def trim_plan(files: DataFrame, start: float = 30.0, seconds: float = 30.0, least: float = 0.0) -> DataFrame:
    """What is cut out of a file for upload: seconds from start on; the beginning of files that end before it. files: duration.

    Adds start and seconds (what is there of them).
    """
    d = F.col("duration")
    begin = F.when(d > start + least, F.lit(start)).otherwise(0.0)
    return files.withColumn("start", begin).withColumn("seconds", F.least(F.lit(seconds), d - F.col("start")))


def consistency(first: DataFrame, more: DataFrame, key: str = "k") -> DataFrame:
    """Cutoff spread in two steps: rows of `more` count only for keys whose first spread lies in 500..1000 Hz.

    first, more: key, cutoff. more is joined after the filter, so its cutoffs need computing for those keys only.
    """
    spread = first.groupBy(key).agg(F.stddev_pop("cutoff").alias("s"))
    grey = spread.where((F.col("s") >= 500) & (F.col("s") <= 1000)).select(key)
    every = first.unionByName(more.join(grey, key, "left_semi"))
    return every.groupBy(key).agg(F.count("*").alias("segments"), F.stddev_pop("cutoff").alias("std"), F.min("cutoff").alias("cutoff"))

"""Signal operators in DataFrame expressions.

Long form: sig (signal), idx (from 0), x (sample). Windows are per signal, so a signal's samples meet in one task;
for whole recordings use the segment plan first, or the kernels in functions.kernels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(sig: str = "sig") -> Window:
    return Window.partitionBy(sig)


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def hann(idx: Column, n: int) -> Column:
    """Symmetric window."""
    return F.lit(0.5) - F.lit(0.5) * F.cos(idx * (2 * math.pi) / (n - 1))


def energy_db(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sig").agg((20 * F.log10(F.sqrt(F.avg(F.col("x") * F.col("x"))) + 1e-10)).alias("energy_db"))


def autocorrelation(rows: DataFrame, lag: int) -> DataFrame:
    """Absolute correlation of x with itself lag samples later; null where a signal has two pairs or fewer."""
    w = by().orderBy("idx")
    return rows.withColumn("y", F.lag("x", lag).over(w)).where("y is not null").groupBy("sig").agg(F.abs(F.corr("x", "y")).alias("autocorr"))


def temporal_std(rows: DataFrame, chunk: int, chunks: int = 5) -> DataFrame:
    """Population deviation of the energies of the first whole chunks; 0 for fewer than two."""
    part = F.floor(F.col("idx") / chunk)
    each = rows.withColumn("part", part).where(F.col("part") < chunks).groupBy("sig", "part").agg(F.count("*").alias("n"), (20 * F.log10(F.sqrt(F.avg(F.col("x") * F.col("x"))) + 1e-10)).alias("db"))
    return each.where(F.col("n") == chunk).groupBy("sig").agg(F.when(F.count("*") > 1, F.stddev_pop("db")).otherwise(0.0).alias("temporal_std"))


def silence_runs(rows: DataFrame, threshold: float, least: int) -> DataFrame:
    """Runs of at least `least` samples below the threshold: sig, start, stop (after the last)."""
    quiet = F.abs("x") < threshold
    w = by().orderBy("idx")
    island = F.col("idx") - F.row_number().over(w)
    runs = rows.where(quiet).withColumn("island", island).groupBy("sig", "island").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("stop"))
    return runs.where(F.col("stop") - F.col("start") >= least).drop("island")


def silence_edges(rows: DataFrame, threshold: float, rate: float, limit: float) -> DataFrame:
    """leading and trailing silence in seconds, and issue: full_silence, both, leading, trailing or none."""
    loud = F.abs("x") > threshold
    a = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min(F.when(loud, F.col("idx"))).alias("first"), F.max(F.when(loud, F.col("idx"))).alias("last"))
    lead = F.when(F.col("first").isNull(), F.col("n") / rate).otherwise(F.col("first") / rate)
    trail = F.when(F.col("first").isNull(), 0.0).otherwise((F.col("n") - 1 - F.col("last")) / rate)
    issue = F.when(F.col("first").isNull(), "full_silence").when((lead > limit) & (trail > limit), "both").when(lead > limit, "leading").when(trail > limit, "trailing").otherwise("none")
    return a.select("sig", lead.alias("leading"), trail.alias("trailing"), issue.alias("issue"))


def moving_average(rows: DataFrame, size: int) -> DataFrame:
    """Mean over idx - size/2 .. idx + size/2 - 1 (for odd sizes: centred), the ends mirrored with their edge sample.

    The mirrored samples are made by row arithmetic: only samples near an end are doubled.
    """
    before, after = size // 2, size - size // 2 - 1
    n = rows.groupBy("sig").agg(F.count("*").alias("n"))
    full = rows.join(n, "sig")
    copies = F.array(F.col("idx"), F.when(F.col("idx") < before, -1 - F.col("idx")), F.when(F.col("n") - 1 - F.col("idx") < after, 2 * F.col("n") - 1 - F.col("idx")))
    wide = full.withColumn("at", F.explode(copies)).where("at is not null")
    w = by().orderBy("at").rowsBetween(-before, after)
    return wide.withColumn("avg", F.avg("x").over(w)).where("at >= 0 and at < n").select("sig", F.col("at").alias("idx"), "avg")


def cumulative_share(rows: DataFrame, share: float) -> DataFrame:
    """The first idx at which the running energy reaches the share of the total."""
    w = by().orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    e = F.col("x") * F.col("x")
    a = rows.withColumn("run", F.sum(e).over(w)).withColumn("all", F.sum(e).over(by()))
    return a.where(F.col("run") >= share * F.col("all")).groupBy("sig").agg(F.min("idx").alias("idx"))


def low_run_of_two(slices: DataFrame) -> DataFrame:
    """First of two consecutive low slices. slices: sig, slice, low (boolean); slices that are missing neither count nor reset."""
    w = by().orderBy("slice")
    a = slices.withColumn("was", F.lag("low").over(w)).withColumn("at", F.lag("slice").over(w))
    return a.where("low and was").groupBy("sig").agg(F.min("at").alias("slice"))


def sliding_corr_median(rows: DataFrame, size: int, hop: int) -> DataFrame:
    """Median over windows [w*hop, w*hop + size) of the absolute correlation of x and y; windows must end before the last sample.

    A sample belongs to at most ceil(size / hop) windows.
    """
    n = rows.groupBy("sig").agg(F.count("*").alias("n"))
    low = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / F.lit(float(hop))))
    a = rows.join(n, "sig").withColumn("w", F.explode(F.sequence(low.cast("long"), F.floor(F.col("idx") / hop).cast("long")))).where(F.col("w") * hop < F.col("n") - size)
    each = a.groupBy("sig", "w").agg(F.abs(F.corr("x", "y")).alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return each.where("sx > 1e-6 and sy > 1e-6").groupBy("sig").agg(F.percentile("c", F.lit(0.5)).alias("corr"))


def dft(frames: DataFrame, size: int) -> DataFrame:
    """Magnitude and dB of each bin 0..size/2 of Hann-windowed frames. frames: vec_id, samples (array of size doubles).

    Angles are row arithmetic, so the sums stay in one row's array.
    """
    step = 2 * math.pi / size
    rows = frames.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(size // 2))))
    at = F.sequence(F.lit(0), F.lit(size - 1))
    windowed = F.zip_with("samples", at, lambda v, i: v * hann(i, size))
    re = F.aggregate(F.zip_with(windowed, at, lambda v, i: v * F.cos(i * F.col("bin") * step)), F.lit(0.0), lambda s, v: s + v)
    im = F.aggregate(F.zip_with(windowed, at, lambda v, i: v * F.sin(i * F.col("bin") * step)), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn("mag", F.sqrt(re * re + im * im)).select("vec_id", "bin", "mag", (20 * F.log10(F.col("mag") + 1e-10)).alias("db"))


def hf_share(spectrum: DataFrame, low: int, width: int) -> DataFrame:
    """Mean over slices of width bins above low of the slice's share of the total magnitude."""
    total = F.sum("mag").over(Window.partitionBy("vec_id"))
    a = spectrum.withColumn("total", total).where(F.col("bin") >= low)
    each = a.groupBy("vec_id", F.floor((F.col("bin") - low) / width).alias("slice")).agg((F.sum("mag") / F.first("total")).alias("share"))
    return each.groupBy("vec_id").agg(F.avg("share").alias("hf_energy"))


def cutoff_bins(spectrum: DataFrame, ref_low: int, ref_high: int, width: int, drop_db: float) -> DataFrame:
    """The cutoff search on bins: the reference is the median level of [ref_low, ref_high]; the cutoff is the first of
    two consecutive slices whose upper quartile lies drop_db below it, else the last bin."""
    ref = spectrum.where(F.col("bin").between(ref_low, ref_high)).groupBy("vec_id").agg((F.percentile("db", F.lit(0.5)) - drop_db).alias("limit"))
    slices = spectrum.where(F.col("bin") >= ref_high).groupBy("vec_id", F.floor((F.col("bin") - ref_high) / width).alias("slice")).agg(F.percentile("db", F.lit(0.75)).alias("level"))
    low = slices.join(ref, "vec_id").select(F.col("vec_id").alias("sig"), "slice", (F.col("level") < F.col("limit")).alias("low"))
    last = spectrum.groupBy("vec_id").agg(F.max("bin").alias("last"))
    return last.join(low_run_of_two(low).withColumnRenamed("sig", "vec_id"), "vec_id", "left").select("vec_id", F.coalesce(F.col("slice") * width + ref_high, F.col("last").cast("long")).alias("cutoff_bin"))


def minmax(samples: Column) -> Column:
    """To [-1, 1]."""
    lo, hi = F.array_min(samples), F.array_max(samples)
    return F.transform(samples, lambda v: 2 * (v - lo) / F.greatest(hi - lo, F.lit(1e-6)) - 1)

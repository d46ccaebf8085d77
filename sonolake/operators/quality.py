"""Quality detectors as aggregates over samples, with their severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clipping(rows: DataFrame, key: str = "sig", frames: Column | None = None) -> DataFrame:
    """percentage of samples at or above 0.99. Over frames (not samples) it can exceed 100, as for whole files."""
    pct = F.count_if(F.abs("x") >= 0.99) / (frames if frames is not None else F.count("*")) * 100
    return rows.groupBy(key).agg(pct.alias("percentage")).withColumns({"has_clipping": F.col("percentage") > 0.01, "severity": clipping_severity(F.col("percentage"))})


def clipping_severity(pct: Column) -> Column:
    return F.when(pct == 0, "none").when(pct < 0.01, "light").when(pct < 0.1, "moderate").otherwise("severe")


def dc_offset(rows: DataFrame, key: str = "sig", threshold: float = 0.001) -> DataFrame:
    return rows.groupBy(key).agg(F.avg("x").alias("offset")).withColumns({"has_dc_offset": F.abs("offset") >= threshold, "severity": dc_severity(F.abs("offset"), threshold)})


def dc_offset_channels(rows: DataFrame, key: str = "sig", channel: str = "channel", threshold: float = 0.001) -> DataFrame:
    """As dc_offset, of arrays: the mean of the channels' means, also where channels differ in length."""
    each = rows.groupBy(key, channel).agg(F.avg("x").alias("m"))
    return each.groupBy(key).agg(F.avg("m").alias("offset")).withColumns({"has_dc_offset": F.abs("offset") >= threshold, "severity": dc_severity(F.abs("offset"), threshold)})


def dc_severity(size: Column, threshold: float = 0.001) -> Column:
    return F.when(size < threshold, "none").when(size < 0.01, "light").when(size < 0.05, "moderate").otherwise("severe")


def true_depth(samples: Column, reported: Column, most: int = 10_000) -> Column:
    """16 if a deeper file's first samples are all multiples of 2**-15, else 24; shallow files as reported."""
    whole = F.forall(F.slice(samples, 1, most), lambda v: F.abs(v * 32768 - F.rint(v * 32768)) < 1e-4)
    return F.when(reported <= 16, reported).when(whole, 16).otherwise(24)


def original_rate(rate: Column, cutoff: Column) -> Column:
    """The likely rate before upsampling, or 0."""
    return F.when((rate <= 48000) | (cutoff >= 24000), 0).when(cutoff < 22500, 44100).otherwise(48000)


def corruption(frames_read: Column, total_frames: Column, error: Column, bad_values: Column, temporary: Column) -> tuple[Column, Column]:
    """(is_corrupted, partial) from how a decode ended; error is null for a decode without exception."""
    failed = error.isNotNull()
    short = frames_read != total_frames
    corrupted = F.when(failed, (frames_read == 0) & ~temporary).otherwise(bad_values | short)
    return corrupted, F.when(failed, (frames_read > 0) | temporary).otherwise(short)

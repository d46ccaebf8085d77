"""Scoring rules as column factories: each takes columns and returns the points as an int column.

Null inputs mean "unknown" and never fire a rule; no rule raises on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CONTAINERS, CUTOFFS, SIGNATURES, TEMPORARY, VERDICTS


def points(*cases: tuple[Column, int]) -> Column:
    """The points of the first case that holds, or 0."""
    return reduce(lambda rest, case: F.when(F.coalesce(case[0], F.lit(False)), F.lit(case[1])).otherwise(rest), reversed(cases), F.lit(0)).cast("int")


def cutoff_threshold(rate: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in CUTOFFS.items() for x in (pair[0], float(pair[1]))))
    return F.coalesce(F.try_element_at(known, rate.cast("int")), rate * F.lit(0.45))


def signature_bitrate(cutoff: Column) -> Column:
    return points(*(((cutoff >= lo) & (cutoff < hi), kbps) for lo, hi, kbps in SIGNATURES))


def mp3_source(cutoff: Column, container: Column, std: Column, rate: Column, energy: Column) -> Column:
    """The MP3 bitrate that cutoff and container agree on, or null."""
    nyquist = rate / 2
    kbps = signature_bitrate(cutoff)
    fits = reduce(lambda a, b: a | b, ((kbps == k) & container.between(lo, hi) for k, (lo, hi) in CONTAINERS.items()))
    clear = (cutoff < 0.95 * nyquist) & ~((cutoff == 20000.0) & ((energy > 1e-6) | (std == 0))) & (cutoff <= 21500) & (std <= 100) & ~((kbps == 320) & (cutoff >= 0.94 * nyquist))
    return F.when(clear & fits, kbps)


def rule1(mp3: Column) -> Column:
    return points((mp3.isNotNull(), 50))


def rule2(cutoff: Column, rate: Column) -> Column:
    missing = cutoff_threshold(rate) - cutoff
    return F.coalesce(F.when(missing > 0, F.least(missing / 200, F.lit(30.0)).cast("int")), F.lit(0))


def rule3(mp3: Column, container: Column) -> Column:
    return points((mp3.isNotNull() & (container > 600), 50))


def rule4(depth: Column, mp3: Column, cutoff: Column, silence_ratio: Column) -> Column:
    return points((silence_ratio < 0.15, 0), ((depth == 24) & (mp3 < 500) & (cutoff < 19000), 30))


def rule5(bitrate: Column, std: Column) -> Column:
    return points(((bitrate > 1000) & (std > 100), -40))


def rule6(mp3: Column, container: Column, cutoff: Column, std: Column) -> Column:
    return points((mp3.isNull() & (container > 700) & (cutoff >= 19000) & (std > 50), -30))


def rule7(cutoff: Column, ratio: Column, vinyl: Column, clicks_per_minute: Column, noise_db: Column) -> Column:
    gated = cutoff.between(19000, 21500) & ratio.isNotNull()
    return points((~gated, 0), (ratio > 0.3, 50), (ratio < 0.15, -50), (vinyl & clicks_per_minute.between(5, 50), -50), (vinyl, -40), (noise_db < -70, 20))


def rule8(cutoff: Column, rate: Column, mp3: Column, ratio: Column) -> Column:
    share = cutoff / (rate / 2)
    base = points((share >= 0.98, -50), (share >= 0.95, -30))
    held = mp3.isNotNull()
    return F.when(F.coalesce(held & (ratio > 0.2) & (base < 0), F.lit(False)), 0).when(F.coalesce(held & (ratio > 0.15) & (base < 0), F.lit(False)), -15).otherwise(base).cast("int")


def rule9(cutoff: Column, mp3: Column, preecho_pct: Column, aliasing: Column, mp3_pattern: Column) -> Column:
    total = points((preecho_pct > 10, 15), (preecho_pct >= 5, 10)) + points((aliasing > 0.5, 15), (aliasing >= 0.3, 10)) + points((mp3_pattern, 10))
    return F.when(F.coalesce((cutoff < 21000) | mp3.isNotNull(), F.lit(False)), total).otherwise(0).cast("int")


def rule10(score: Column, std: Column, problematic: Column) -> Column:
    """problematic: number of segments whose own R1 and R2 points exceed 50."""
    return points((score <= 30, 0), (std > 1000, -20), (problematic == 1, -30))


def segment_problem(cutoff: Column, container: Column, rate: Column) -> Column:
    mp3 = mp3_source(cutoff, container, F.lit(0.0), rate, F.lit(0.0))
    return (rule1(mp3) + rule2(cutoff, rate)) > 50


def rule11(cutoff: Column, std: Column, hiss_db: Column, hiss_corr: Column, slope: Column, mp3_pattern: Column) -> Column:
    total = (
        points(((hiss_db > -55) & (hiss_corr < 0.2), 30))
        + points(((slope > -6) & (slope < -3), 20), (slope < -10, -20))
        + points((~F.coalesce(mp3_pattern, F.lit(False)), 15))
        + points(((std > 50) & (std < 300), 15), (std < 30, -10))
    )
    return F.when(F.coalesce(cutoff < 19000, F.lit(False)), F.greatest(F.lit(0), total)).otherwise(0).cast("int")


def rule12(probability: Column) -> Column:
    p = F.coalesce(probability, F.lit(0.0))
    return F.when(p < 0.5, 0).when(p >= 0.95, 30).otherwise(F.bround((p - 0.5) / 0.45 * 30)).cast("int")


def rule12_level(probability: Column) -> Column:
    return F.when(probability >= 0.95, "very high").when(probability >= 0.8, "high").when(probability >= 0.65, "moderate").when(probability >= 0.5, "low")


def clamped_fold(*deltas: Column) -> Column:
    """Adds deltas in order, never below 0 in between: not the same as the sum."""
    return F.aggregate(F.array(*deltas), F.lit(0), lambda score, d: F.greatest(F.lit(0), score + d)).cast("int")


def verdict(score: Column) -> Column:
    return reduce(lambda rest, v: F.when(score >= v[0], v[1]).otherwise(rest), reversed(VERDICTS[:-1]), F.lit(VERDICTS[-1][1]))


def confidence(score: Column) -> Column:
    return reduce(lambda rest, v: F.when(score >= v[0], v[2]).otherwise(rest), reversed(VERDICTS[:-1]), F.lit(VERDICTS[-1][2]))


def real_bitrate(size: Column, duration: Column) -> Column:
    return F.when(duration > 0, size * 8 / (duration * 1000)).otherwise(0.0)


def bitrate_spread(size: Column, duration: Column, parts: int = 10) -> Column:
    """Population deviation of the bitrates of a file cut into equal parts: without the frames' own sizes all parts are alike."""
    each = real_bitrate(size / parts, duration / parts)
    mean = F.aggregate(F.array_repeat(each, parts), F.lit(0.0), lambda s, v: s + v) / parts
    return F.sqrt(F.aggregate(F.array_repeat(each, parts), F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / parts)


def apparent_bitrate(rate: Column, depth: Column, channels: Column) -> Column:
    return F.floor(rate.cast("long") * depth * channels / 1000).cast("int")


def duration_gap(meta: Column, real: Column, rate: Column) -> Column:
    """Difference in samples of two durations in seconds."""
    return F.abs((meta * rate).cast("long") - (real * rate).cast("long"))


def temporary_error(message: Column) -> Column:
    return F.lower(message).rlike("|".join(TEMPORARY))


def legacy_score(cutoff: Column, rate: Column, energy: Column, duration_ms: Column, encoder: Column, depth: Column) -> Column:
    """The earlier scale, from 100 (authentic) down, clamped once at the end."""
    limit, kbps = rate / 2 * 0.95, signature_bitrate(cutoff)
    cut = points((kbps == 320, -40), (kbps == 256, -50), (kbps == 224, -60), (kbps == 192, -70), (kbps > 0, -80), (cutoff < limit, -60))
    least = F.when(cutoff >= limit, 1e-5).otherwise(1e-4)
    total = (
        F.lit(100) + cut + points((energy < least, -10))
        + points((duration_ms > 1000, -20), (duration_ms > 100, -10)) + points((F.lower(encoder).rlike("lame|mp3"), -30)) + points((depth < 16, -20))
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")

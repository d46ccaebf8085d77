"""Texts that say why rules gave points: column factories beside those of rules, each an array of strings, empty if a rule is silent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .constants import REASONS


def number(x: Column, digits: int = 0) -> Column:
    """Rounded half to even, as text."""
    return F.format_string(f"%.{digits}f", F.bround(x.cast("double"), digits))


def text(name: str, *values: Column) -> Column:
    return F.format_string(REASONS[name], *values) if values else F.lit(REASONS[name].replace("%%", "%"))


def first(*cases: tuple[Column, Column]) -> Column:
    """The text of the first case that holds."""
    out = None
    for condition, t in cases:
        held = F.coalesce(condition, F.lit(False))
        out = F.when(held, F.array(t)) if out is None else out.when(held, F.array(t))
    return out.otherwise(F.array().cast("array<string>"))


def only(condition: Column, *parts: Column) -> Column:
    """The parts together if the condition holds."""
    return F.when(F.coalesce(condition, F.lit(False)), F.concat(*parts)).otherwise(F.array().cast("array<string>"))


def rule1(mp3: Column) -> Column:
    return first((mp3.isNotNull(), text("r1", mp3.cast("string"))))


def rule2(cutoff: Column, rate: Column) -> Column:
    threshold = R.cutoff_threshold(rate)
    return first((cutoff < threshold, text("r2", number(cutoff), number(threshold), number(F.least((threshold - cutoff) / 200, F.lit(30.0))))))


def rule3(mp3: Column, container: Column) -> Column:
    return first((R.rule3(mp3, container) > 0, text("r3", mp3.cast("string"), number(container))))


def rule4(depth: Column, mp3: Column, cutoff: Column, silence_ratio: Column) -> Column:
    return first((R.rule4(depth, mp3, cutoff, silence_ratio) > 0, text("r4", mp3.cast("string"), number(cutoff))))


def rule5(bitrate: Column, std: Column) -> Column:
    return first((R.rule5(bitrate, std) < 0, text("r5", number(bitrate), number(std))))


def rule6(mp3: Column, container: Column, cutoff: Column, std: Column) -> Column:
    return first((R.rule6(mp3, container, cutoff, std) < 0, text("r6", number(container), number(cutoff), number(std))))


def rule7(cutoff: Column, ratio: Column, vinyl: Column, clicks_per_minute: Column, noise_db: Column, noise_corr: Column) -> Column:
    vinyl_text = F.array(text("r7_vinyl", number(noise_db, 1), number(noise_corr, 2)))
    phase2 = F.when(F.coalesce(vinyl, F.lit(False)), F.concat(vinyl_text, first((clicks_per_minute.between(5, 50), text("r7_clicks", number(clicks_per_minute, 1)))))).otherwise(
        first((noise_db < -70, text("r7_none", number(noise_db, 1))), (noise_corr.isNotNull(), text("r7_pattern", number(noise_corr, 2))))
    )
    clear = first((ratio > 0.3, text("r7_dither", number(ratio, 2))), (ratio < 0.15, text("r7_clean", number(ratio, 2))))
    return only(cutoff.between(19000, 21500) & ratio.isNotNull(), F.when(F.size(clear) > 0, clear).otherwise(phase2))


def rule8(cutoff: Column, rate: Column, mp3: Column, ratio: Column) -> Column:
    nyquist = rate / 2
    share = cutoff / nyquist
    place = (number(share * 100, 1), number(cutoff), number(nyquist))
    bonus = F.when(share >= 0.98, F.lit(REASONS["r8_close"])).otherwise(F.lit(REASONS["r8_likely"]))
    points = F.when(share >= 0.98, F.lit("-50")).otherwise(F.lit("-30"))
    return only(share >= 0.95, first(
        (mp3.isNotNull() & (ratio > 0.2), text("r8_cancelled", mp3.cast("string"), number(ratio, 2))), (mp3.isNotNull() & (ratio > 0.15), text("r8_reduced", *place)),
        (mp3.isNotNull(), text("r8_mp3", *place, bonus, points)), (F.lit(True), text("r8", *place, bonus, points)),
    ))


def rule9(cutoff: Column, mp3: Column, preecho_pct: Column, aliasing: Column, mp3_pattern: Column) -> Column:
    return only(
        (cutoff < 21000) | mp3.isNotNull(),
        first((preecho_pct > 10, text("r9_preecho", number(preecho_pct, 1))), (preecho_pct >= 5, text("r9_preecho_some", number(preecho_pct, 1)))),
        first((aliasing > 0.5, text("r9_aliasing", number(aliasing, 2))), (aliasing >= 0.3, text("r9_aliasing_some", number(aliasing, 2)))),
        first((mp3_pattern, text("r9_pattern"))),
    )


def rule10(score: Column, std: Column, problematic: Column) -> Column:
    return only(score > 30, first((std > 1000, text("r10_spread", number(std))), (problematic == 1, text("r10_local")), ((std < 500) & (problematic >= 3), text("r10_whole", number(std)))))


def rule11(cutoff: Column, std: Column, hiss_db: Column, hiss_corr: Column, slope: Column, mp3_pattern: Column) -> Column:
    return only(
        cutoff < 19000,
        first(((hiss_db > -55) & (hiss_corr < 0.2), text("r11_hiss", number(hiss_db, 1)))),
        first(((slope > -6) & (slope < -3), text("r11_natural", number(slope, 1))), (slope < -10, text("r11_sharp", number(slope, 1)))),
        first((~F.coalesce(mp3_pattern, F.lit(False)), text("r11_no_mp3"))),
        first(((std > 50) & (std < 300), text("r11_flutter", number(std))), (std < 30, text("r11_stable", number(std)))),
    )


def rule12(probability: Column) -> Column:
    return first((probability >= 0.5, text("r12", number(probability, 2), R.rule12_level(probability), R.rule12(probability).cast("string"))))


def joined(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, F.array_join(reasons, REASONS["separator"])).otherwise(F.lit(REASONS["none"]))

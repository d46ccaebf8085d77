"""The live scoring plan: rules in their order, a clamped score, and the exits that stop it early.

Cheap rules are columns of one projection. Rows that they decide leave the plan before features that are
expensive to make are asked for: a Python function inside CASE WHEN would be evaluated for all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reasons as W
from ..functions import rules as R

CERTAIN = 86


def add(score: F.Column, delta: F.Column) -> F.Column:
    return F.greatest(F.lit(0), score + delta)


def cheap(rows: DataFrame) -> DataFrame:
    """Scores from cutoff, container, std, rate, depth, energy, cassette (R11 points of rows below 19 kHz).

    Adds mp3, r1..r4, score, decided and reasons. A cassette of 30 points takes 40 off and leaves R1 out.
    cassette_reasons (an array) may say why a cassette was heard. R5 and R6 take the file's own bitrate spread, which is 0 for evenly cut files, so that they never fire here.
    """
    tape = F.coalesce("cassette", F.lit(0))
    is_tape = tape >= 30
    mp3 = F.when(~is_tape, R.mp3_source(F.col("cutoff"), F.col("container"), F.col("std"), F.col("rate"), F.col("energy")))
    a = rows.withColumn("mp3", mp3).withColumns({
        "r1": R.rule1(F.col("mp3")), "r2": R.rule2(F.col("cutoff"), F.col("rate")), "r3": R.rule3(F.col("mp3"), F.col("container")),
        "r4": R.rule4(F.col("depth"), F.col("mp3"), F.col("cutoff"), F.lit(None).cast("double")),
        "r8_base": R.rule8(F.col("cutoff"), F.col("rate"), F.lit(None).cast("int"), F.lit(None).cast("double")),
    })
    bonus = F.when(is_tape, -40).otherwise(0)
    score = R.clamped_fold(F.col("r8_base"), tape, bonus, F.col("r1"), F.col("r2"), F.col("r3"), F.col("r4"))
    a = a.withColumn("score", score)
    a = a.withColumn("decided", (F.col("score") >= CERTAIN) | ((F.col("score") < 10) & F.col("mp3").isNull()))
    c, mp3 = F.col("cutoff"), F.col("mp3")
    heard = F.col("cassette_reasons") if "cassette_reasons" in rows.columns else F.array().cast("array<string>")
    early = F.concat(
        heard, W.first((is_tape, W.text("r11_bonus"))), W.rule1(mp3), W.rule2(c, F.col("rate")), W.rule3(mp3, F.col("container")), W.rule4(F.col("depth"), mp3, c, F.lit(None).cast("double")),
        W.first((F.col("score") >= CERTAIN, W.text("fast_fake")), (F.col("decided"), W.text("fast_authentic"))),
    )
    # what R8 says first is said anew by its second run, of rows that it comes to
    first = F.when(mp3.isNull() | F.col("decided"), W.rule8(c, F.col("rate"), F.lit(None).cast("int"), F.lit(None).cast("double"))).otherwise(F.array().cast("array<string>"))
    return a.withColumn("reasons", F.concat(first, early))


def expensive(rows: DataFrame) -> DataFrame:
    """R7, R9 and the second R8 of undecided rows; needs ratio, vinyl, clicks, noise_db, preecho, aliasing, pattern."""
    c, mp3 = F.col("cutoff"), F.col("mp3")
    ratio = F.when(c.between(19000, 21500), F.col("ratio"))
    r7 = R.rule7(c, ratio, F.col("vinyl"), F.col("clicks"), F.col("noise_db"))
    r9 = R.rule9(c, mp3, F.col("preecho"), F.col("aliasing"), F.col("pattern"))
    again = F.when(mp3.isNotNull(), R.rule8(c, F.col("rate"), mp3, ratio) - F.col("r8_base")).otherwise(0)
    corr = F.col("noise_corr") if "noise_corr" in rows.columns else F.lit(None).cast("double")
    why = F.concat(
        "reasons", W.rule7(c, ratio, F.col("vinyl"), F.col("clicks"), F.col("noise_db"), corr), W.rule9(c, mp3, F.col("preecho"), F.col("aliasing"), F.col("pattern")),
        W.only(mp3.isNotNull(), W.rule8(c, F.col("rate"), mp3, ratio)),
    )
    a = rows.withColumns({"r7": r7, "r9": r9, "r8": again, "reasons": why})
    return a.withColumn("score", R.clamped_fold(F.col("score"), F.col("r7"), F.col("r9"), F.col("r8")))


def final(rows: DataFrame) -> DataFrame:
    """R10 (above 30 points) and R12, unless the score is certain by then; needs segment_std, problematic, probability."""
    r10 = R.rule10(F.col("score"), F.col("segment_std"), F.col("problematic"))
    last = R.clamped_fold(F.col("score"), r10, R.rule12(F.col("probability")))
    open_rows = F.col("score") < CERTAIN
    why = F.concat("reasons", W.only(open_rows, W.rule10(F.col("score"), F.col("segment_std"), F.col("problematic")), W.rule12(F.col("probability"))))
    return rows.withColumns({"reasons": why, "score": F.when(open_rows, last).otherwise(F.col("score"))})


def live(rows: DataFrame, with_features: Callable[[DataFrame], DataFrame] = lambda x: x, with_segments: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """rows with score, verdict, confidence and reason. The two functions add the columns that later stages need, for undecided rows only."""
    keep = [*rows.columns, "mp3", "score", "reasons"]
    first = cheap(rows)
    second = expensive(with_features(first.where(~F.col("decided"))))
    third = final(with_segments(second))
    out = first.where("decided").select(*keep).unionByName(third.select(*keep))
    return out.withColumns({"verdict": R.verdict(F.col("score")), "confidence": R.confidence(F.col("score")), "reason": W.joined(F.col("reasons"))}).drop("reasons")

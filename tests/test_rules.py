"""Rule points at their boundaries, and the clamped fold against plain Python."""

import itertools

import pytest
from pyspark.sql import functions as F

from sonolake.functions import rules as R
from sonolake.plans import scoring


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def L(x, kind="double"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize("cutoff, container, std, rate, energy, mp3", [
    (19800, 850, 0, 44100, 0, 320), (17458, 700, 0, 44100, 0, 192), (17458, 844, 0, 44100, 0, None), (18321, 1623, 0, 44100, 0, None), (18321, 700, 0, 48000, 0, 224),
    (21878, 1580, 0, 44100, 0, None), (21600, 850, 0, 44100, 0, None), (20000, 850, 0, 44100, 0, None), (20000, 850, 10, 44100, 0, 320), (19800, 850, 101, 44100, 0, None),
])
def test_rule1(spark, cutoff, container, std, rate, energy, mp3):
    found = R.mp3_source(L(cutoff), L(container), L(std), L(rate), L(energy))
    assert value(spark, found) == mp3
    assert value(spark, R.rule1(found)) == (50 if mp3 else 0)


@pytest.mark.parametrize("cutoff, rate, points", [(19800, 44100, 1), (17458, 44100, 12), (18321, 48000, 18), (21878, 44100, 0), (1000, 44100, 30), (20000, 50000, 12)])
def test_rule2(spark, cutoff, rate, points):
    assert value(spark, R.rule2(L(cutoff), L(rate))) == points


@pytest.mark.parametrize("depth, mp3, cutoff, ratio, points", [(24, 192, 17000, None, 30), (24, 192, 20000, None, 0), (24, 192, 17000, 0.10, 0), (24, 192, 17000, 0.15, 30), (16, 192, 17000, None, 0), (24, None, 17000, None, 0), (24, 600, 17000, None, 0), (24, 192, 19000, None, 0)])
def test_rule4(spark, depth, mp3, cutoff, ratio, points):
    assert value(spark, R.rule4(L(depth), L(mp3), L(cutoff), L(ratio))) == points


def test_rules_3_5_6(spark):
    assert value(spark, R.rule3(L(320), L(849))) == 50 and value(spark, R.rule3(L(None), L(849))) == 0
    assert value(spark, R.rule5(L(1580), L(200))) == -40 and value(spark, R.rule5(L(850), L(150))) == 0
    for args, points in [((None, 800, 20000, 100), -30), ((320, 800, 20000, 100), 0), ((None, 700, 19000, 51), 0), ((None, 701, 19000, 51), -30), ((None, 701, 19000, 50), 0)]:
        assert value(spark, R.rule6(*map(L, args))) == points


@pytest.mark.parametrize("cutoff, ratio, vinyl, clicks, db, points", [(20000, 0.45, False, 0, -60, 50), (20000, 0.05, False, 0, -60, -50), (20000, 0.2, True, 0, -60, -40), (20000, 0.2, True, 20, -60, -50), (20000, 0.2, False, 0, -80, 20), (20000, 0.2, False, 0, -60, 0), (18000, 0.45, False, 0, -60, 0), (22000, 0.45, False, 0, -60, 0), (20000, None, False, 0, -60, 0)])
def test_rule7(spark, cutoff, ratio, vinyl, clicks, db, points):
    assert value(spark, R.rule7(L(cutoff), L(ratio), F.lit(vinyl), L(clicks), L(db))) == points


@pytest.mark.parametrize("cutoff, rate, mp3, ratio, points", [(21800, 44100, None, None, -50), (21000, 44100, None, None, -30), (20000, 44100, None, None, 0), (21800, 44100, 320, 0.3, 0), (21800, 44100, 320, 0.18, -15), (21800, 44100, 320, 0.05, -50), (23600, 48000, None, None, -50), (46000, 96000, None, None, -30)])
def test_rule8(spark, cutoff, rate, mp3, ratio, points):
    assert value(spark, R.rule8(L(cutoff), L(rate), L(mp3), L(ratio))) == points


def test_rules_9_to_12(spark):
    assert value(spark, R.rule9(L(18000), L(None), L(12), L(0.6), F.lit(True))) == 40
    assert value(spark, R.rule9(L(18000), L(None), L(15), L(0.1), F.lit(False))) == 15
    assert value(spark, R.rule9(L(21500), L(None), L(15), L(0.1), F.lit(False))) == 0
    assert value(spark, R.rule10(L(31), L(1001), L(5))) == -20 and value(spark, R.rule10(L(31), L(400), L(1))) == -30 and value(spark, R.rule10(L(30), L(1001), L(1))) == 0
    assert value(spark, R.rule11(L(20000), L(100), L(-20), L(0), L(-4), F.lit(False))) == 0
    assert value(spark, R.rule11(L(15000), L(100), L(-20), L(0), L(-4), F.lit(False))) == 80
    assert [value(spark, R.rule12(L(p))) for p in (0.49, 0.5, 0.8, 0.95, None)] == [0, 0, 20, 30, 0]


def test_lookups(spark):
    assert [value(spark, R.cutoff_threshold(F.lit(r))) for r in (44100, 48000, 88200, 96000, 50000)] == [20000, 22000, 40000, 44000, 22500]
    assert [value(spark, R.signature_bitrate(L(c))) for c in (20500, 21166, 19075, 16000, 22000)] == [320, 320, 256, 160, 0]
    assert value(spark, R.apparent_bitrate(F.lit(44100), F.lit(16), F.lit(2))) == 1411 and value(spark, R.apparent_bitrate(F.lit(48000), F.lit(24), F.lit(2))) == 2304
    messages = {"flac decoder lost sync": True, "FLAC DECODER LOST SYNC": True, "invalid frame header": True, "unexpected end of file": True, "file not found": False, "out of memory": False}
    for m, temporary in messages.items():
        assert value(spark, R.temporary_error(F.lit(m))) is temporary


def test_fold_is_clamped_at_every_step(spark):
    cases = list(itertools.product((-50, 0, 30), (-30, 20, 50), (-40, 15)))
    rows = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "a int, b int, c int, i int")
    for r in rows.select("*", R.clamped_fold(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect():
        s = 0
        for d in (r.a, r.b, r.c):
            s = max(0, s + d)
        assert r.s == s
    assert value(spark, R.clamped_fold(L(-50, "int"), L(30, "int"), L(20, "int"))) == 50


def test_whole_scores(spark):
    """MP3 at 320; 256 inside 24 bits; a poor and a good authentic file."""
    rows = spark.createDataFrame([("a", 20500.0, 851.0, 50.0, 44100, 16), ("b", 19143.0, 725.0, 30.0, 48000, 24), ("c", 18000.0, 850.0, 150.0, 44100, 16), ("d", 21878.0, 1580.0, 200.0, 44100, 16)], "id string, cutoff double, container double, std double, rate int, depth int")
    none = {c: F.lit(None).cast("double") for c in ("energy", "ratio", "clicks", "noise_db", "preecho", "aliasing", "segment_std", "probability")}
    rows = rows.withColumns(none | {"energy": F.lit(0.0), "vinyl": F.lit(False), "pattern": F.lit(False), "cassette": F.lit(0), "problematic": F.lit(0)})
    got = {r.id: (r.score, r.verdict) for r in scoring.live(rows).collect()}
    assert got == {"a": (100, "FAKE_CERTAIN"), "b": (114, "FAKE_CERTAIN"), "c": (10, "AUTHENTIC"), "d": (0, "AUTHENTIC")}

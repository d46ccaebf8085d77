"""Rules, their composition and the scalars they use, on feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import reasons as W
from ..functions import rules as R
from ..operators import lookups
from . import scoring
from .adaptors import FEATURES_SQL, features, table
from .registry import query


KBPS_SQL = "CASE WHEN cutoff >= 19500 AND cutoff < 21500 THEN 320 WHEN cutoff >= 18500 AND cutoff < 19500 THEN 256 WHEN cutoff >= 17500 AND cutoff < 18500 THEN 224 WHEN cutoff >= 16500 AND cutoff < 17500 THEN 192 WHEN cutoff >= 15500 AND cutoff < 16500 THEN 160 WHEN cutoff >= 10000 AND cutoff < 15500 THEN 128 ELSE 0 END"
THRESHOLD_SQL = "CASE rate WHEN 44100 THEN 20000.0::DOUBLE WHEN 48000 THEN 22000.0::DOUBLE WHEN 88200 THEN 40000.0::DOUBLE WHEN 96000 THEN 44000.0::DOUBLE WHEN 176400 THEN 80000.0::DOUBLE WHEN 192000 THEN 88000.0::DOUBLE ELSE rate * 0.45::DOUBLE END"
WITH_MP3 = f"""WITH {FEATURES_SQL}, b AS (SELECT *, {KBPS_SQL} AS kbps FROM f), m AS (SELECT *, CASE
  WHEN cutoff >= 0.95::DOUBLE * (rate / 2.0::DOUBLE) OR (cutoff = 20000 AND (energy > 1e-6::DOUBLE OR std = 0)) OR cutoff > 21500 OR std > 100
    OR (kbps = 320 AND cutoff >= 0.94::DOUBLE * (rate / 2.0::DOUBLE)) THEN NULL
  WHEN (kbps = 128 AND container BETWEEN 400 AND 550) OR (kbps = 160 AND container BETWEEN 450 AND 650) OR (kbps = 192 AND container BETWEEN 500 AND 750)
    OR (kbps = 224 AND container BETWEEN 550 AND 800) OR (kbps = 256 AND container BETWEEN 600 AND 850) OR (kbps = 320 AND container BETWEEN 700 AND 1050) THEN kbps
  END AS mp3 FROM b)"""
R2_SQL = f"CASE WHEN cutoff < {THRESHOLD_SQL} THEN CAST(trunc(least(({THRESHOLD_SQL} - cutoff) / 200, 30)) AS INTEGER) ELSE 0 END"
R3_SQL = "CASE WHEN mp3 IS NOT NULL AND container > 600 THEN 50 ELSE 0 END"
R4_SQL = "CASE WHEN ratio < 0.15::DOUBLE THEN 0 WHEN depth = 24 AND mp3 < 500 AND cutoff < 19000 THEN 30 ELSE 0 END"
BASE8_SQL = "CASE WHEN cutoff / (rate / 2.0::DOUBLE) >= 0.98::DOUBLE THEN -50 WHEN cutoff / (rate / 2.0::DOUBLE) >= 0.95::DOUBLE THEN -30 ELSE 0 END"
R7_SQL = "CASE WHEN cutoff < 19000 OR cutoff > 21500 OR ratio IS NULL THEN 0 WHEN ratio > 0.3::DOUBLE THEN 50 WHEN ratio < 0.15::DOUBLE THEN -50 WHEN vinyl THEN CASE WHEN clicks BETWEEN 5 AND 50 THEN -50 ELSE -40 END WHEN noise_db < -70 THEN 20 ELSE 0 END"
R9_SQL = "CASE WHEN cutoff < 21000 OR mp3 IS NOT NULL THEN (CASE WHEN preecho > 10 THEN 15 WHEN preecho >= 5 THEN 10 ELSE 0 END) + (CASE WHEN aliasing > 0.5::DOUBLE THEN 15 WHEN aliasing >= 0.3::DOUBLE THEN 10 ELSE 0 END) + (CASE WHEN pattern THEN 10 ELSE 0 END) ELSE 0 END"
R10_SQL = "CASE WHEN {score} <= 30 THEN 0 WHEN segment_std > 1000 THEN -20 WHEN problematic = 1 THEN -30 ELSE 0 END"
R11_SQL = """CASE WHEN cutoff < 19000 THEN greatest(0, (CASE WHEN hiss_db > -55 AND hiss_corr < 0.2::DOUBLE THEN 30 ELSE 0 END) + (CASE WHEN slope > -6 AND slope < -3 THEN 20 WHEN slope < -10 THEN -20 ELSE 0 END)
  + (CASE WHEN {pattern} THEN 0 ELSE 15 END) + (CASE WHEN std > 50 AND std < 300 THEN 15 WHEN std < 30 THEN -10 ELSE 0 END)) ELSE 0 END"""
R12_SQL = "CASE WHEN coalesce(probability, 0) < 0.5::DOUBLE THEN 0 WHEN probability >= 0.95::DOUBLE THEN 30 ELSE CAST(round_even((probability - 0.5::DOUBLE) / 0.45::DOUBLE * 30, 0) AS INTEGER) END"
VERDICT_SQL = "CASE WHEN score >= 86 THEN 'FAKE_CERTAIN' WHEN score >= 61 THEN 'SUSPICIOUS' WHEN score >= 31 THEN 'WARNING' ELSE 'AUTHENTIC' END"
FOLD_SQL = "list_reduce([0, {deltas}], lambda a, x: greatest(0, a + x))"
#: The whole live composition; leaves score and verdict in the relation v.
LIVE_SQL = f"""{WITH_MP3.replace("m AS (", "m0 AS (")}, t AS (SELECT *, {R11_SQL.format(pattern="false")} AS tape FROM m0),
m AS (SELECT * EXCLUDE (mp3), CASE WHEN tape < 30 THEN mp3 END AS mp3 FROM t),
a AS (SELECT *, {FOLD_SQL.format(deltas=f"{BASE8_SQL}, tape, CASE WHEN tape >= 30 THEN -40 ELSE 0 END, CASE WHEN mp3 IS NOT NULL THEN 50 ELSE 0 END, {R2_SQL}, {R3_SQL}, CASE WHEN depth = 24 AND mp3 < 500 AND cutoff < 19000 THEN 30 ELSE 0 END")} AS s1 FROM m),
d AS (SELECT *, s1 >= 86 OR (s1 < 10 AND mp3 IS NULL) AS decided FROM a),
r8 AS (SELECT *, {BASE8_SQL} AS base8, CASE WHEN cutoff BETWEEN 19000 AND 21500 THEN ratio END AS used FROM d),
x AS (SELECT *, {FOLD_SQL.format(deltas=f"s1, {R7_SQL}, {R9_SQL}, CASE WHEN mp3 IS NULL THEN 0 WHEN base8 < 0 AND used > 0.2::DOUBLE THEN -base8 WHEN base8 < 0 AND used > 0.15::DOUBLE THEN -15 - base8 ELSE 0 END")} AS s2 FROM r8),
v AS (SELECT *, {VERDICT_SQL} AS verdict FROM (SELECT *, CAST(CASE WHEN decided THEN s1 WHEN s2 >= 86 THEN s2 ELSE {FOLD_SQL.format(deltas=f"s2, {R10_SQL.format(score='s2')}, {R12_SQL}")} END AS INTEGER) AS score FROM x))"""


def _n(x: str, digits: int = 0) -> str:
    return f"printf('%.{digits}f', round_even({x}, {digits}))"


_PLACE = f"{_n('cutoff / (rate / 2.0::DOUBLE) * 100', 1)} || '% de Nyquist (' || {_n('cutoff')} || '/' || {_n('rate / 2.0::DOUBLE')} || ' Hz) → '"
_BONUS = "CASE WHEN cutoff / (rate / 2.0::DOUBLE) >= 0.98::DOUBLE THEN 'Très proche limite (-50pts' ELSE 'Probablement authentique (-30pts' END"
#: Texts in the order in which rules speak: (condition, text).
_SAID = [
    (f"{BASE8_SQL} < 0 AND (mp3 IS NULL OR decided)", f"'R8: Cutoff à ' || {_PLACE} || {_BONUS} || ')'"),
    ("cutoff < 19000 AND hiss_db > -55 AND hiss_corr < 0.2::DOUBLE", f"'R11A: Bruit de bande détecté (' || {_n('hiss_db', 1)} || ' dB, aléatoire) (Prob. Cassette)'"),
    ("cutoff < 19000 AND slope > -6 AND slope < -3", f"'R11B: Roll-off naturel cassette (' || {_n('slope', 1)} || ' dB/kHz) (Prob. Cassette)'"),
    ("cutoff < 19000 AND slope < -10", f"'R11B: Coupure nette numérique (' || {_n('slope', 1)} || ' dB/kHz) (Prob. Numérique)'"),
    ("cutoff < 19000", "'R11C: Aucun pattern MP3 détecté (compatible cassette) (Prob. Cassette)'"),
    ("cutoff < 19000 AND std > 50 AND std < 300", f"'R11D: Variation cutoff naturelle (' || {_n('std')} || ' Hz, wow/flutter) (Prob. Cassette)'"),
    ("cutoff < 19000 AND std < 30", f"'R11D: Cutoff très stable (' || {_n('std')} || ' Hz, suspect digital) (Prob. Numérique)'"),
    ("tape >= 30", "'R11: Source cassette audio authentique (Bonus -40pts)'"),
    ("mp3 IS NOT NULL", "'Constant MP3 bitrate detected (Spectral): ' || mp3 || ' kbps'"),
    (f"cutoff < {THRESHOLD_SQL}", f"'R2: Cutoff ' || {_n('cutoff')} || ' Hz < ' || {_n(THRESHOLD_SQL)} || ' Hz (+' || {_n(f'least(({THRESHOLD_SQL} - cutoff) / 200, 30)')} || 'pts)'"),
    ("mp3 IS NOT NULL AND container > 600", f"'R3: Source ' || mp3 || ' kbps vs conteneur ' || {_n('container')} || ' kbps'"),
    ("depth = 24 AND mp3 < 500 AND cutoff < 19000", f"'R4: 24-bit avec bitrate source ' || mp3 || ' kbps et cutoff ' || {_n('cutoff')} || ' Hz (upscale suspect)'"),
    ("s1 >= 86", "'⚡ Analyse rapide : FAKE_CERTAIN détecté sans règles coûteuses'"),
    ("s1 < 86 AND decided", "'⚡ Analyse rapide : AUTHENTIC détecté sans règles coûteuses'"),
    ("NOT decided AND used > 0.3::DOUBLE", f"'R7-P1: Dither artificiel détecté dans les silences (Ratio ' || {_n('used', 2)} || ' > 0.3) (+50pts)'"),
    ("NOT decided AND used < 0.15::DOUBLE", f"'R7-P1: Silence naturel propre (Ratio ' || {_n('used', 2)} || ' < 0.15) (-50pts)'"),
    ("NOT decided AND used BETWEEN 0.15::DOUBLE AND 0.3::DOUBLE AND vinyl", f"'R7-P2: Bruit vinyle détecté (énergie=' || {_n('noise_db', 1)} || 'dB, autocorr=' || {_n('noise_corr', 2)} || ') (-40pts)'"),
    ("NOT decided AND used BETWEEN 0.15::DOUBLE AND 0.3::DOUBLE AND vinyl AND clicks BETWEEN 5 AND 50", f"'R7-P3: Clicks vinyle détectés (' || {_n('clicks', 1)} || ' clicks/min) (-10pts)'"),
    ("NOT decided AND used BETWEEN 0.15::DOUBLE AND 0.3::DOUBLE AND NOT vinyl AND noise_db < -70", f"'R7-P2: Pas de bruit au-dessus du cutoff (énergie=' || {_n('noise_db', 1)} || 'dB) -> Upsampling digital suspect (+20pts)'"),
    ("NOT decided AND used BETWEEN 0.15::DOUBLE AND 0.3::DOUBLE AND NOT vinyl AND noise_db >= -70", f"'R7-P2: Bruit avec pattern détecté (autocorr=' || {_n('noise_corr', 2)} || ') -> Incertain (0pts)'"),
    ("NOT decided AND (cutoff < 21000 OR mp3 IS NOT NULL) AND preecho > 10", f"'R9A: Pré-echo détecté (' || {_n('preecho', 1)} || '% transitoires affectées) (+15pts)'"),
    ("NOT decided AND (cutoff < 21000 OR mp3 IS NOT NULL) AND preecho >= 5 AND preecho <= 10", f"'R9A: Pré-echo modéré (' || {_n('preecho', 1)} || '% transitoires) (+10pts)'"),
    ("NOT decided AND (cutoff < 21000 OR mp3 IS NOT NULL) AND aliasing > 0.5::DOUBLE", f"'R9B: Aliasing HF fort (corr=' || {_n('aliasing', 2)} || ') (+15pts)'"),
    ("NOT decided AND (cutoff < 21000 OR mp3 IS NOT NULL) AND aliasing >= 0.3::DOUBLE AND aliasing <= 0.5::DOUBLE", f"'R9B: Aliasing HF modéré (corr=' || {_n('aliasing', 2)} || ') (+10pts)'"),
    ("NOT decided AND (cutoff < 21000 OR mp3 IS NOT NULL) AND pattern", "'R9C: Pattern de bruit MP3 détecté (+10pts)'"),
    ("NOT decided AND mp3 IS NOT NULL AND base8 < 0 AND used > 0.2::DOUBLE", f"'R8: Bonus Nyquist annulé (MP3 signature ' || mp3 || ' kbps + dither suspect ' || {_n('used', 2)} || ' > 0.2)'"),
    ("NOT decided AND mp3 IS NOT NULL AND base8 < 0 AND used > 0.15::DOUBLE AND used <= 0.2::DOUBLE", f"'R8: Cutoff à ' || {_PLACE} || 'Bonus réduit (MP3 signature + zone grise) (-15pts)'"),
    ("NOT decided AND mp3 IS NOT NULL AND base8 < 0 AND (used IS NULL OR used <= 0.15::DOUBLE)", f"'R8: Cutoff à ' || {_PLACE} || {_BONUS} || ', MP3 signature mais silence authentique)'"),
    ("NOT decided AND s2 < 86 AND s2 > 30 AND segment_std > 1000", f"'R10: Cutoff variance élevée (' || {_n('segment_std')} || ' Hz) -> Mastering dynamique probable (-20pts)'"),
    ("NOT decided AND s2 < 86 AND s2 > 30 AND segment_std <= 1000 AND problematic = 1", "'R10: Anomalie locale détectée (1 seul segment problématique) -> Artefact probable (-30pts)'"),
    ("NOT decided AND s2 < 86 AND s2 > 30 AND segment_std < 500 AND problematic >= 3", f"'R10: Anomalie cohérente sur tout le fichier (Variance ' || {_n('segment_std')} || ' Hz)'"),
    ("NOT decided AND s2 < 86 AND probability >= 0.5::DOUBLE", f"'R12: CNN classifier flags transcode (p=' || {_n('probability', 2)} || ', confidence=' || CASE WHEN probability >= 0.95::DOUBLE THEN 'very high' WHEN probability >= 0.8::DOUBLE THEN 'high' WHEN probability >= 0.65::DOUBLE THEN 'moderate' ELSE 'low' END || ', +' || {R12_SQL} || 'pts)'"),
]
REASON_SQL = "coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in _SAID) + "], lambda t: t IS NOT NULL), ' | '), ''), 'No anomaly detected')"


def mp3_source() -> Column:
    return R.mp3_source(F.col("cutoff"), F.col("container"), F.col("std"), F.col("rate"), F.col("energy"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = (F.col("cutoff"), F.col("std"), F.col("hiss_db"), F.col("hiss_corr"), F.col("slope"), F.lit(False))
    return scoring.live(features(spark, sf_dir).withColumns({"cassette": R.rule11(*heard), "cassette_reasons": W.rule11(*heard)}))


@query(f"{WITH_MP3} SELECT k, CASE WHEN mp3 IS NOT NULL THEN 50 ELSE 0 END AS points, mp3 FROM m")
def rule1_mp3_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.rule1(mp3_source()).alias("points"), mp3_source().alias("mp3"))


@query(f"WITH {FEATURES_SQL} SELECT k, {R2_SQL} AS points FROM f")
def rule2_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.rule2(F.col("cutoff"), F.col("rate")).alias("points"))


@query(f"{WITH_MP3} SELECT k, {R3_SQL} AS points FROM m")
def rule3_source_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.rule3(mp3_source(), F.col("container")).alias("points"))


@query(f"{WITH_MP3} SELECT k, {R4_SQL} AS points FROM m")
def rule4_bit_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.rule4(F.col("depth"), mp3_source(), F.col("cutoff"), F.col("ratio")).alias("points"))


@query(f"WITH {FEATURES_SQL} SELECT k, CASE WHEN container > 1000 AND std > 100 THEN -40 ELSE 0 END AS points FROM f")
def rule5_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.rule5(F.col("container"), F.col("std")).alias("points"))


@query(f"{WITH_MP3} SELECT k, CASE WHEN mp3 IS NULL AND container > 700 AND cutoff >= 19000 AND std > 50 THEN -30 ELSE 0 END AS points FROM m")
def rule6_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.rule6(mp3_source(), F.col("container"), F.col("cutoff"), F.col("std")).alias("points"))


@query(f"WITH {FEATURES_SQL} SELECT k, {R7_SQL} AS points FROM f")
def rule7_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.rule7(F.col("cutoff"), F.col("ratio"), F.col("vinyl"), F.col("clicks"), F.col("noise_db")).alias("points"))


@query(f"{WITH_MP3} SELECT k, CASE WHEN mp3 IS NOT NULL AND ratio > 0.2::DOUBLE AND {BASE8_SQL} < 0 THEN 0 WHEN mp3 IS NOT NULL AND ratio > 0.15::DOUBLE AND {BASE8_SQL} < 0 THEN -15 ELSE {BASE8_SQL} END AS points FROM (SELECT * EXCLUDE (mp3), CASE WHEN k % 2 = 0 THEN 320 END AS mp3 FROM m)")
def rule8_nyquist(spark: SparkSession, sf_dir: str) -> DataFrame:
    mp3 = F.when(F.col("k") % 2 == 0, 320)
    return features(spark, sf_dir).select("k", R.rule8(F.col("cutoff"), F.col("rate"), mp3, F.col("ratio")).alias("points"))


@query(f"{WITH_MP3} SELECT k, {R9_SQL} AS points FROM m")
def rule9_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.rule9(F.col("cutoff"), mp3_source(), F.col("preecho"), F.col("aliasing"), F.col("pattern")).alias("points"))


@query(f"WITH {FEATURES_SQL} SELECT k, {R10_SQL.format(score='(k % 90)')} AS points FROM f")
def rule10_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.rule10(F.col("k") % 90, F.col("segment_std"), F.col("problematic")).alias("points"))


@query(f"WITH {FEATURES_SQL} SELECT k, {R11_SQL.format(pattern='pattern')} AS points FROM f")
def rule11_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.rule11(F.col("cutoff"), F.col("std"), F.col("hiss_db"), F.col("hiss_corr"), F.col("slope"), F.col("pattern")).alias("points"))


@query(f"WITH {FEATURES_SQL} SELECT k, {R12_SQL} AS points, CASE WHEN probability >= 0.95::DOUBLE THEN 'very high' WHEN probability >= 0.8::DOUBLE THEN 'high' WHEN probability >= 0.65::DOUBLE THEN 'moderate' WHEN probability >= 0.5::DOUBLE THEN 'low' END AS level FROM f")
def rule12_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.rule12(F.col("probability")).alias("points"), R.rule12_level(F.col("probability")).alias("level"))


@query(f"WITH {FEATURES_SQL} SELECT k, CAST({FOLD_SQL.format(deltas='-(k % 50), k % 31, k % 7 * 10, -30, k % 3 * 20')} AS INTEGER) AS score FROM f")
def score_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("int")
    return features(spark, sf_dir).select("k", R.clamped_fold(-(k % 50), k % 31, k % 7 * 10, F.lit(-30), k % 3 * 20).alias("score"))


@query(f"{LIVE_SQL} SELECT k, mp3, score, verdict FROM v")
def live_pipeline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("k", "mp3", "score", "verdict")


@query(f"{LIVE_SQL} SELECT k, verdict, {REASON_SQL} AS reason FROM v")
def live_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("k", "verdict", "reason")


@query(f"{LIVE_SQL} SELECT verdict, count(*) AS n_files, min(score) AS min_score, max(score) AS max_score FROM v GROUP BY verdict")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n_files"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


@query(f"""WITH {FEATURES_SQL}, b AS (SELECT *, {KBPS_SQL} AS kbps, rate / 2.0::DOUBLE * 0.95::DOUBLE AS lim FROM f)
SELECT k, CAST(greatest(0, least(100, 100 + CASE WHEN kbps = 320 THEN -40 WHEN kbps = 256 THEN -50 WHEN kbps = 224 THEN -60 WHEN kbps = 192 THEN -70 WHEN kbps > 0 THEN -80 WHEN cutoff < lim THEN -60 ELSE 0 END
 + CASE WHEN energy < CASE WHEN cutoff >= lim THEN 1e-5::DOUBLE ELSE 1e-4::DOUBLE END THEN -10 ELSE 0 END + CASE WHEN gap_ms > 1000 THEN -20 WHEN gap_ms > 100 THEN -10 ELSE 0 END
 + CASE WHEN k % 13 = 0 THEN -30 ELSE 0 END + CASE WHEN depth < 20 AND k % 4 = 0 THEN -20 ELSE 0 END)) AS INTEGER) AS score FROM b""")
def legacy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    encoder = F.when(k % 13 == 0, "LAME3.100").otherwise("reference libFLAC")
    depth = F.when((F.col("depth") < 20) & (k % 4 == 0), 8).otherwise(24)
    return features(spark, sf_dir).select("k", R.legacy_score(F.col("cutoff"), F.col("rate"), F.col("energy"), F.col("gap_ms"), encoder, depth).alias("score"))


@query(f"WITH {FEATURES_SQL} SELECT k, {KBPS_SQL} AS kbps FROM f")
def signature_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return lookups.signature_join(rows).select("k", "kbps")


@query(f"WITH {FEATURES_SQL} SELECT k, {THRESHOLD_SQL} AS threshold FROM f")
def cutoff_threshold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", R.cutoff_threshold(F.col("rate")).alias("threshold"))


@query(f"WITH {FEATURES_SQL} SELECT k, CASE WHEN k % 10 > 0 THEN round((k * 1000) * 8 / ((k % 10) * 1000.0::DOUBLE), 6) ELSE 0.0::DOUBLE END AS real_kbps, CAST(trunc(rate * depth * 2 / 1000.0::DOUBLE) AS INTEGER) AS apparent_kbps, round(list_aggregate(list_transform(range(10), lambda i: CASE WHEN k % 10 > 0 THEN (k * 100) * 8 / ((k % 10) / 10.0::DOUBLE * 1000) ELSE 0 END), 'stddev_pop'), 6) AS spread FROM f")
def bitrates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return features(spark, sf_dir).select("k", F.round(R.real_bitrate(k * 1000, (k % 10).cast("double")), 6).alias("real_kbps"), R.apparent_bitrate(F.col("rate"), F.col("depth"), F.lit(2)).alias("apparent_kbps"), F.round(R.bitrate_spread(k * 1000, (k % 10).cast("double")), 6).alias("spread"))


@query(f"""WITH {FEATURES_SQL}, g AS (SELECT k, rate, abs(CAST(trunc((k % 300 + 0.5::DOUBLE) * rate) AS BIGINT) - CAST(trunc((k % 300 + 0.5::DOUBLE + gap_ms / 50000) * rate) AS BIGINT)) AS gap FROM f)
SELECT k, gap, gap > 588 AS mismatch, round(gap / rate * 1000.0::DOUBLE, 6) AS gap_ms FROM g""")
def duration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.col("k") % 300 + F.lit(0.5)
    gap = R.duration_gap(meta, meta + F.col("gap_ms") / 50000, F.col("rate"))
    return features(spark, sf_dir).select("k", gap.alias("gap"), (gap > K.DURATION_TOLERANCE).alias("mismatch"), F.round(gap / F.col("rate") * 1000, 6).alias("gap_ms"))


@query("""SELECT p_partkey AS k, coalesce(TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN 'N/A' WHEN p_partkey % 3 = 1 THEN '48000' END AS INTEGER), 44100) AS rate,
coalesce(TRY_CAST(CASE WHEN p_partkey % 4 = 0 THEN '24' WHEN p_partkey % 4 = 1 THEN 'deep' END AS INTEGER), 16) AS depth, coalesce(TRY_CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR END AS DOUBLE), 0.0::DOUBLE) AS duration FROM part""")
def parse_metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(
        k.alias("k"), F.when(k % 3 == 0, "N/A").when(k % 3 == 1, "48000").alias("sample_rate"), F.when(k % 4 == 0, "24").when(k % 4 == 1, "deep").alias("bit_depth"),
        F.lit(None).cast("string").alias("channels"), F.when(k % 2 == 0, k.cast("string")).alias("duration"),
    )
    return lookups.parse_metadata(raw).select("k", F.col("sample_rate").alias("rate"), F.col("bit_depth").alias("depth"), "duration")

"""Signal, spectrum and quality operators on signals and frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import vector_udfs
from ..operators import quality, segments, signal_sql as S
from .adaptors import FEATURES_SQL, FRAMES_SQL, SIGNALS_SQL, features, frames, signals
from .registry import query

DFT_SQL = f"""{FRAMES_SQL}, b AS (SELECT vec_id, bin, samples FROM e, (SELECT unnest(range(33)) AS bin)), p AS (SELECT vec_id, bin, i, samples[CAST(i + 1 AS INTEGER)] * (0.5 - 0.5 * cos(i * (2 * pi()) / 63)) AS v FROM b, (SELECT unnest(range(64)) AS i)),
d AS (SELECT vec_id, CAST(bin AS INTEGER) AS bin, sqrt(pow(sum(v * cos(i * bin * (2 * pi() / 64))), 2) + pow(sum(v * sin(i * bin * (2 * pi() / 64))), 2)) AS mag FROM p GROUP BY vec_id, bin)"""
CUTOFF_SQL = f"""WITH {DFT_SQL}, q AS (SELECT *, 20 * log10(mag + 1e-10::DOUBLE) AS db FROM d), lim AS (SELECT vec_id, quantile_cont(db, 0.5) - 3 AS lim FROM q WHERE bin BETWEEN 8 AND 12 GROUP BY vec_id),
sl AS (SELECT vec_id, (bin - 12) // 2 AS slice, quantile_cont(db, 0.75) AS lev FROM q WHERE bin >= 12 GROUP BY ALL), lo AS (SELECT vec_id, slice, lev < lim AS low FROM sl JOIN lim USING (vec_id)),
w AS (SELECT vec_id, slice, low, lag(low) OVER (PARTITION BY vec_id ORDER BY slice) AS was, lag(slice) OVER (PARTITION BY vec_id ORDER BY slice) AS prev FROM lo), f AS (SELECT vec_id, min(prev) AS slice FROM w WHERE low AND was GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(f.slice * 2 + 12, 32) AS BIGINT) AS cutoff_bin FROM e LEFT JOIN f USING (vec_id)"""


@query(f"WITH {DFT_SQL} SELECT vec_id, bin, round(mag, 6) AS mag FROM d")
def dft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dft(frames(spark, sf_dir), 64).select("vec_id", "bin", F.round("mag", 6).alias("mag"))


@query(f"WITH {DFT_SQL} SELECT vec_id, bin, round(mag, 6) AS mag FROM d")
def dft_magnitude_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_udfs.spectra(frames(spark, sf_dir)).select("vec_id", F.posexplode("mag").alias("bin", "m")).select("vec_id", "bin", F.round("m", 6).alias("mag"))


@query("SELECT CAST(i AS INTEGER) AS i, round(0.5 - 0.5 * cos(2 * pi() * i / 63), 9) AS w FROM range(64) t(i)")
def hann_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias("i"), F.round(S.hann(F.col("id"), 64), 9).alias("w"))


@query(f"WITH {DFT_SQL}, t AS (SELECT *, sum(mag) OVER (PARTITION BY vec_id) AS total FROM d), s AS (SELECT vec_id, (bin - 16) // 4 AS slice, sum(mag) / any_value(total) AS share FROM t WHERE bin >= 16 GROUP BY ALL) SELECT vec_id, round(avg(share), 6) AS hf_energy FROM s GROUP BY vec_id")
def hf_energy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hf_share(S.dft(frames(spark, sf_dir), 64), 16, 4).select("vec_id", F.round("hf_energy", 6).alias("hf_energy"))


@query(CUTOFF_SQL)
def detect_cutoff_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cutoff_bins(S.dft(frames(spark, sf_dir), 64), 8, 12, 2, 3.0)


@query(CUTOFF_SQL)
def detect_cutoff_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_udfs.cutoff_bins(frames(spark, sf_dir), 8, 12, 2, 3.0)


@query(f"WITH {SIGNALS_SQL}, q AS (SELECT sig, idx, idx - row_number() OVER (PARTITION BY sig ORDER BY idx) AS g FROM s WHERE abs(x) < 0.3::DOUBLE), r AS (SELECT sig, min(idx) AS start, max(idx) + 1 AS stop FROM q GROUP BY sig, g) SELECT * FROM r WHERE stop - start >= 3")
def silence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.silence_runs(signals(spark, sf_dir), 0.3, 3).select("sig", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query(f"""WITH {SIGNALS_SQL}, a AS (SELECT sig, count(*) AS n, min(idx) FILTER (abs(x) > 0.8::DOUBLE) AS f, max(idx) FILTER (abs(x) > 0.8::DOUBLE) AS l FROM s GROUP BY sig), b AS (SELECT sig, f, CASE WHEN f IS NULL THEN n / 2.0::DOUBLE ELSE f / 2.0::DOUBLE END AS lead, CASE WHEN f IS NULL THEN 0.0::DOUBLE ELSE (n - 1 - l) / 2.0::DOUBLE END AS trail FROM a)
SELECT sig, round(lead, 2) AS leading, round(trail, 2) AS trailing, CASE WHEN f IS NULL THEN 'full_silence' WHEN lead > 2 AND trail > 2 THEN 'both' WHEN lead > 2 THEN 'leading' WHEN trail > 2 THEN 'trailing' ELSE 'none' END AS issue FROM b""")
def silence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.silence_edges(signals(spark, sf_dir), 0.8, 2.0, 2.0).select("sig", F.round("leading", 2).alias("leading"), F.round("trailing", 2).alias("trailing"), "issue")


@query(f"""WITH {SIGNALS_SQL}, n AS (SELECT sig, count(*) AS n FROM s GROUP BY sig), wide AS (SELECT sig, idx AS pos, x FROM s UNION ALL SELECT sig, -1 - idx, x FROM s WHERE idx < 5 UNION ALL SELECT s.sig, 2 * n - 1 - idx, x FROM s JOIN n USING (sig) WHERE n - 1 - idx < 4),
a AS (SELECT sig, pos, avg(x) OVER (PARTITION BY sig ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m FROM wide) SELECT sig, pos AS idx, round(m, 6) AS avg FROM a JOIN n USING (sig) WHERE pos >= 0 AND pos < n""")
def moving_average_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.moving_average(signals(spark, sf_dir), 10).select("sig", F.col("idx").cast("long").alias("idx"), F.round("avg", 6).alias("avg"))


@query(f"WITH {SIGNALS_SQL}, sl AS (SELECT sig, idx // 4 AS slice, avg(x) < 0.45::DOUBLE AS low FROM s GROUP BY ALL), w AS (SELECT *, lag(low) OVER (PARTITION BY sig ORDER BY slice) AS was, lag(slice) OVER (PARTITION BY sig ORDER BY slice) AS prev FROM sl) SELECT sig, CAST(min(prev) AS BIGINT) AS slice FROM w WHERE low AND was GROUP BY sig")
def run_of_two_low_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = signals(spark, sf_dir).groupBy("sig", F.floor(F.col("idx") / 4).alias("slice")).agg((F.avg("x") < 0.45).alias("low"))
    return S.low_run_of_two(slices)


@query(f"WITH {SIGNALS_SQL}, a AS (SELECT sig, idx, sum(x * x) OVER (PARTITION BY sig ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run, sum(x * x) OVER (PARTITION BY sig) AS total FROM s) SELECT sig, CAST(min(idx) AS BIGINT) AS idx FROM a WHERE run >= 0.9::DOUBLE * total GROUP BY sig")
def cumulative_energy_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cumulative_share(signals(spark, sf_dir), 0.9).select("sig", F.col("idx").cast("long").alias("idx"))


@query(f"WITH {SIGNALS_SQL}, p AS (SELECT sig, x, lag(x, 5) OVER (PARTITION BY sig ORDER BY idx) AS y FROM s) SELECT sig, round(abs(corr(x, y)), 6) AS autocorr FROM p WHERE y IS NOT NULL GROUP BY sig")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.autocorrelation(signals(spark, sf_dir), 5).select("sig", F.round("autocorr", 6).alias("autocorr"))


@query(f"WITH {SIGNALS_SQL}, c AS (SELECT sig, idx // 10 AS part, count(*) AS n, 20 * log10(sqrt(avg(x * x)) + 1e-10::DOUBLE) AS db FROM s WHERE idx < 50 GROUP BY ALL) SELECT sig, round(CASE WHEN count(*) > 1 THEN stddev_pop(db) ELSE 0 END, 6) AS temporal_std FROM c WHERE n = 10 GROUP BY sig")
def temporal_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.temporal_std(signals(spark, sf_dir), 10).select("sig", F.round("temporal_std", 6).alias("temporal_std"))


@query(f"WITH {SIGNALS_SQL} SELECT sig, round(20 * log10(sqrt(avg(x * x)) + 1e-10::DOUBLE), 6) AS energy_db FROM s GROUP BY sig")
def energy_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.energy_db(signals(spark, sf_dir)).select("sig", F.round("energy_db", 6).alias("energy_db"))


@query(f"""WITH {SIGNALS_SQL}, n AS (SELECT sig, count(*) AS n FROM s GROUP BY sig), w AS (SELECT s.sig, x, lag_x AS y, wi FROM (SELECT *, x * x - (idx % 7) / 10.0::DOUBLE AS lag_x FROM s) s JOIN n USING (sig), (SELECT unnest(range(40)) AS wi) WHERE idx >= wi * 10 AND idx < wi * 10 + 20 AND wi * 10 < n - 20),
c AS (SELECT sig, wi, abs(corr(x, y)) AS c FROM w GROUP BY sig, wi) SELECT sig, round(quantile_cont(c, 0.5), 6) AS corr FROM c GROUP BY sig""")
def sliding_corr_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).withColumn("y", F.col("x") * F.col("x") - (F.col("idx") % 7) / 10)
    return S.sliding_corr_median(rows, 20, 10).select("sig", F.round("corr", 6).alias("corr"))


@query(f"WITH {SIGNALS_SQL}, p AS (SELECT sig, count(*) FILTER (abs(x) >= 0.97::DOUBLE * 1.0206185567::DOUBLE) AS clipped, count(*) AS n FROM s GROUP BY sig) SELECT sig, round(clipped / n::DOUBLE * 100, 4) AS percentage, clipped / n::DOUBLE * 100 > 0.01::DOUBLE AS has_clipping, CASE WHEN clipped = 0 THEN 'none' WHEN clipped / n::DOUBLE * 100 < 0.01::DOUBLE THEN 'light' WHEN clipped / n::DOUBLE * 100 < 0.1::DOUBLE THEN 'moderate' ELSE 'severe' END AS severity FROM p".replace("0.97::DOUBLE * 1.0206185567::DOUBLE", "0.99::DOUBLE"))
def clipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clipping(signals(spark, sf_dir)).select("sig", F.round("percentage", 4).alias("percentage"), "has_clipping", "severity")


@query(f"WITH {SIGNALS_SQL}, p AS (SELECT sig, count(*) FILTER (abs(x) >= 0.99::DOUBLE) / (count(*) / 2.0::DOUBLE) * 100 AS pct FROM s GROUP BY sig) SELECT sig, round(pct, 4) AS percentage FROM p")
def clipping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples a frame: the share is taken of frames."""
    return quality.clipping(signals(spark, sf_dir), frames=F.count("*") / 2).select("sig", F.round("percentage", 4).alias("percentage"))


@query(f"WITH {SIGNALS_SQL}, p AS (SELECT sig, avg(x - 0.49::DOUBLE) AS m FROM s GROUP BY sig) SELECT sig, round(m, 6) AS dc_offset, abs(m) >= 0.001::DOUBLE AS has_dc_offset, CASE WHEN abs(m) < 0.001::DOUBLE THEN 'none' WHEN abs(m) < 0.01::DOUBLE THEN 'light' WHEN abs(m) < 0.05::DOUBLE THEN 'moderate' ELSE 'severe' END AS severity FROM p")
def dc_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).withColumn("x", F.col("x") - 0.49)
    return quality.dc_offset(rows).select("sig", F.round("offset", 6).alias("dc_offset"), "has_dc_offset", "severity")


@query(f"WITH {FRAMES_SQL}, q AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 16 ELSE 24 END AS reported, list_transform(samples, lambda v: CASE WHEN vec_id % 2 = 0 THEN round_even(v * 32768, 0) / 32768 ELSE v END) AS y FROM e) SELECT vec_id, CASE WHEN reported <= 16 THEN reported WHEN list_bool_and(list_transform(y, lambda v: abs(v * 32768 - round_even(v * 32768, 0)) < 1e-4::DOUBLE)) THEN 16 ELSE 24 END AS depth FROM q")
def bit_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    y = F.transform("samples", lambda v: F.when(k % 2 == 0, F.rint(v * 32768) / 32768).otherwise(v))
    return frames(spark, sf_dir).select("vec_id", quality.true_depth(y, F.when(k % 3 == 0, 16).otherwise(24)).alias("depth"))


@query(f"WITH {FEATURES_SQL}, g AS (SELECT k, rate, cutoff + (k % 3) * 1500 AS cutoff FROM f) SELECT k, CASE WHEN rate <= 48000 OR cutoff >= 24000 THEN 0 WHEN cutoff < 22500 THEN 44100 ELSE 48000 END AS original_rate FROM g")
def upsampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("k", quality.original_rate(F.col("rate"), F.col("cutoff") + (F.col("k") % 3) * 1500).alias("original_rate"))


@query(f"WITH {FEATURES_SQL} SELECT k, CASE WHEN k % 4 = 0 THEN (k % 8 = 0) AND NOT (k % 3 = 0) ELSE (k % 5 = 0) OR (k % 9 = 0) END AS is_corrupted, CASE WHEN k % 4 = 0 THEN NOT (k % 8 = 0) OR (k % 3 = 0) ELSE k % 9 = 0 END AS partial FROM f")
def corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    read = F.when(k % 4 == 0, F.when(k % 8 == 0, 0).otherwise(10)).otherwise(F.when(k % 9 == 0, 99).otherwise(100))
    bad, partial = quality.corruption(read, F.lit(100), F.when(k % 4 == 0, "lost"), k % 5 == 0, k % 3 == 0)
    return features(spark, sf_dir).select("k", bad.alias("is_corrupted"), partial.alias("partial"))


@query(f"""WITH {FEATURES_SQL}, g AS (SELECT k, rate, CAST(k % 400 AS DOUBLE) AS d FROM f), n AS (SELECT *, CASE WHEN d > 90 THEN 3 ELSE 1 END AS n FROM g), x AS (SELECT k, rate, d, n, CAST(unnest(range(n)) AS INTEGER) AS seg FROM n), y AS (SELECT *, least(30.0::DOUBLE, d / n) AS len FROM x)
SELECT k, seg, CAST(trunc(greatest(0, d / (n + 1) * (seg + 1) - len / 2) * rate) AS BIGINT) AS start, CAST(trunc(len * rate) AS BIGINT) AS frames FROM y""")
def segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = features(spark, sf_dir).select("k", "rate", (F.col("k") % 400).cast("double").alias("duration"))
    return segments.spectrum_plan(files).select("k", "seg", "start", "frames")


@query(f"""WITH {FEATURES_SQL}, c AS (SELECT k, p, 15000 + CAST((k * (p + 3) * 7) % 2500 AS DOUBLE) AS cutoff FROM f, (SELECT unnest(range(5)) AS p)), s AS (SELECT k FROM c WHERE p < 2 GROUP BY k HAVING stddev_pop(cutoff) BETWEEN 500 AND 1000)
SELECT k, count(*) AS segments, round(stddev_pop(cutoff), 6) AS std, min(cutoff) AS cutoff FROM c WHERE p < 2 OR k IN (SELECT k FROM s) GROUP BY k""")
def consistency_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    at = lambda lo, hi: features(spark, sf_dir).select("k", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("p")).select("k", (15000 + ((k * (F.col("p") + 3) * 7) % 2500).cast("double")).alias("cutoff"))
    return segments.consistency(at(0, 1), at(2, 4)).select("k", "segments", F.round("std", 6).alias("std"), "cutoff")


@query(f"WITH {FRAMES_SQL}, m AS (SELECT vec_id, samples, list_min(samples) AS lo, list_max(samples) AS hi FROM e) SELECT vec_id, round(list_sum(list_transform(samples, lambda v: abs(2 * (v - lo) / greatest(hi - lo, 1e-6::DOUBLE) - 1))), 5) AS total FROM m")
def minmax_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = frames(spark, sf_dir).select("vec_id", S.minmax(F.col("samples")).alias("y"))
    return scaled.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + F.abs(v)), 5).alias("total"))


@query(f"WITH {FEATURES_SQL}, g AS (SELECT k, CAST(k % 90 AS DOUBLE) AS d FROM f) SELECT k, CASE WHEN d > 30 THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END AS start, least(30.0::DOUBLE, CASE WHEN d > 30 THEN d - 30 ELSE d END) AS seconds FROM g")
def trim_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = features(spark, sf_dir).select("k", (F.col("k") % 90).cast("double").alias("duration"))
    return segments.trim_plan(files).select("k", "start", "seconds")


@query(f"WITH {SIGNALS_SQL}, c AS (SELECT sig, idx % 2 AS channel, avg(x - 0.49::DOUBLE) AS m FROM s GROUP BY ALL), p AS (SELECT sig, avg(m) AS m FROM c GROUP BY sig) SELECT sig, round(m, 6) AS dc_offset, CASE WHEN abs(m) < 0.001::DOUBLE THEN 'none' WHEN abs(m) < 0.01::DOUBLE THEN 'light' WHEN abs(m) < 0.05::DOUBLE THEN 'moderate' ELSE 'severe' END AS severity FROM p")
def dc_offset_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).withColumns({"x": F.col("x") - 0.49, "channel": F.col("idx") % 2})
    return quality.dc_offset_channels(rows).select("sig", F.round("offset", 6).alias("dc_offset"), "severity")


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal a row: sig, samples."""
    return signals(spark, sf_dir).groupBy("sig").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("samples"))


@query(f"""WITH {SIGNALS_SQL}, n AS (SELECT sig, count(*) AS n FROM s GROUP BY sig), w AS (SELECT sig, idx, x FROM s UNION ALL SELECT sig, -1 - i, 0 FROM n, (SELECT unnest(range(3)) AS i) UNION ALL SELECT sig, n + i, 0 FROM n, (SELECT unnest(range(3)) AS i)),
m AS (SELECT sig, idx, median(x) OVER (PARTITION BY sig ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM w) SELECT sig, idx, round(m, 6) AS value FROM m JOIN n USING (sig) WHERE idx >= 0 AND idx < n""")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the kernel that the click and pre-echo detectors use."""
    return vector_udfs.mapped(whole(spark, sf_dir), "sig", lambda x: K.median_filter(x, 7, block=16)).select("sig", F.posexplode("values").alias("idx", "v")).select("sig", F.col("idx").cast("long").alias("idx"), F.round("v", 6).alias("value"))


@query(f"WITH {SIGNALS_SQL}, w AS (SELECT *, lag(x) OVER (PARTITION BY sig ORDER BY idx) AS a, lead(x) OVER (PARTITION BY sig ORDER BY idx) AS b FROM s) SELECT sig, idx FROM w WHERE x > a AND x > b AND x >= 0.5::DOUBLE")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the kernel of the detectors, without a least distance (no two neighbours of a signal are equal in the data)."""
    return vector_udfs.mapped(whole(spark, sf_dir), "sig", lambda x: K.peaks(x, 0.5, 1)).select("sig", F.explode("values").alias("v")).select("sig", F.col("v").cast("long").alias("idx"))


@query(f"""WITH {FRAMES_SQL}, b AS (SELECT vec_id, bin, samples FROM e, (SELECT unnest(range(8, 16)) AS bin)), p AS (SELECT vec_id, bin, i, samples[CAST(i + 1 AS INTEGER)] * (0.5 - 0.5 * cos(i * (2 * pi()) / 63)) AS v FROM b, (SELECT unnest(range(64)) AS i)),
d AS (SELECT vec_id, bin, pow(sum(v * cos(i * bin * (2 * pi() / 64))), 2) + pow(sum(v * sin(i * bin * (2 * pi() / 64))), 2) AS power FROM p GROUP BY vec_id, bin) SELECT vec_id, round(sum(power) / 64, 6) AS energy FROM d GROUP BY vec_id""")
def band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of bins 8 to 15 at a rate of 64, by the kernel."""
    found = vector_udfs.mapped(frames(spark, sf_dir), "vec_id", lambda x: np.array([K.band_energy(x, 64.0, 8.0, 16.0)]))
    return found.select("vec_id", F.round(F.get("values", F.lit(0)), 6).alias("energy"))


def _filter_sql() -> str:
    """The filter's difference equation, sample after sample; its factors are made anew from zeros, poles and gain."""
    zeros, poles, gain = K.butterworth(2, "bandpass", 8_000.0, 12_000.0, 44_100.0)
    b, a = (gain * np.real(np.poly(zeros))).tolist(), np.real(np.poly(poles)).tolist()
    past = " + ".join(f"{c!r}::DOUBLE * coalesce(xs[CAST(i + 1 - {k} AS INTEGER)], 0)" if k <= 0 else f"CASE WHEN i >= {k} THEN {c!r}::DOUBLE * xs[CAST(i + 1 - {k} AS INTEGER)] ELSE 0 END" for k, c in enumerate(b))
    back = " ".join(f"- CASE WHEN i >= {k} THEN {c!r}::DOUBLE * ys[CAST(i + 1 - {k} AS INTEGER)] ELSE 0 END" for k, c in enumerate(a) if k)
    return f"""WITH RECURSIVE {SIGNALS_SQL}, w AS (SELECT sig, list(x ORDER BY idx) AS xs FROM s GROUP BY sig),
r AS (SELECT sig, xs, 0 AS i, CAST([] AS DOUBLE[]) AS ys FROM w UNION ALL SELECT sig, xs, i + 1, list_append(ys, CAST({past} {back} AS DOUBLE)) FROM r WHERE i < len(xs))
SELECT sig, CAST(unnest(range(len(ys))) AS BIGINT) AS idx, round(unnest(ys), 6) AS value FROM r WHERE i = len(xs)"""


@query(_filter_sql())
def bandpass_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the kernel, a convolution with the impulse response."""
    found = vector_udfs.mapped(whole(spark, sf_dir), "sig", lambda x: K.bandpass(x, 44_100.0, 8_000.0, 12_000.0, 2))
    return found.select("sig", F.posexplode("values").alias("idx", "v")).select("sig", F.col("idx").cast("long").alias("idx"), F.round("v", 6).alias("value"))


@query()
def kernel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, envelope, transients, pre-echo, aliasing and MP3 pattern of signals, by the array kernels."""
    return vector_udfs.artifact_features(whole(spark, sf_dir), "sig", 44100)


@query()
def mel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mel spectra of the frames, tiled to the kernel's window."""
    return vector_udfs.mel_means(frames(spark, sf_dir), 44100)

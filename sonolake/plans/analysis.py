"""From audio files to result rows: scan, decode, measure, score, check quality.

Every file is decoded once for what all files need. Only files that the cheap rules leave open are read again, for
silence, vinyl and codec artifacts, and only those then above 30 points for the consistency of segments, of which only the
segments are decoded. Rows carry paths; a task reads one file's bytes at a time. What a step measured is written to the shared
folder, so that the steps' branches don't decode anew.

A file that cannot be read or decoded becomes a row with the verdict ERROR; it never fails the scan. Samples of PCM files are
integers, so that values that are not finite can only come from a decoder's fault; every sample is looked at for them.
"""

from __future__ import annotations

import struct
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import reasons as W
from ..functions import rules as R
from ..functions.constants import DURATION_TOLERANCE, SAMPLE_SECONDS
from ..operators import quality, report
from ..runtime import materialise, ship_code
from ..sources import files as source
from ..sources import flac, scan, wav
from . import scoring

#: Bytes of files for each task of a second look.
TASK_BYTES = 128 << 20
#: What damaged or odd files make the readers and kernels raise.
DAMAGE = (ValueError, ArithmeticError, LookupError, EOFError, OSError, wave.Error, struct.error, MemoryError)
#: Gives the function from a normalised mel spectrum to the probability of a transcode; called once a task.
Model = Callable[[], Callable[[np.ndarray], float]]
MEASURES = (
    "path string, length long, rate int, depth int, channels int, duration double, total_frames long, frames_read long, encoder string, error string, cutoff double, energy double, std double, "
    "clipped long, mean double, leading double, trailing double, silent boolean, whole16 boolean, bad_values boolean, hiss_db double, hiss_corr double, slope double, retries int"
)
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def decode(path: str, data: bytes, start: int = 0, frames: int | None = None) -> tuple[np.ndarray, int, int, int, str | None, str | None]:
    """Samples, rate, depth, total frames, encoder tag and what stopped the decoder, of a FLAC or WAV file."""
    if path.lower().endswith(".wav"):
        x, rate, depth, total = wav.read_wav(data, start, frames)
        return x, rate, depth, total, None, None
    x, head, error = flac.read_flac(data, start, frames)
    tag = head.tags.get("ENCODER", [None])[0]
    return x, head.sample_rate, head.bit_depth, head.total_frames or len(x), tag or head.vendor, error


def load(path: str) -> tuple[tuple, int]:
    """decode() of a whole file, read again after temporary failures, and how often it was."""
    return source.with_retries(path, lambda data: decode(path, data))


def plan(duration: float, sample_seconds: float) -> list[tuple[float, float]]:
    """As operators.segments.spectrum_plan, for one file: starts and lengths in seconds."""
    n = 3 if duration > 90 else 1
    size = min(sample_seconds, duration / n)
    return [(max(0.0, duration / (n + 1) * (i + 1) - size / 2), size) for i in range(n)]


def measure(path: str, length: int, sample_seconds: float) -> tuple:
    (x, rate, depth, total, encoder, error), retries = load(path)
    if not len(x):
        raise flac.Broken(error or "no frame can be decoded")
    m, read = K.mono(x), len(x)
    seconds = read / rate
    cuts, energies = [], []
    for start, size in plan(seconds, sample_seconds):
        part = m[int(start * rate) : int(start * rate) + int(size * rate)]
        if len(part) > 1:
            freq, mag, db = K.spectrum(part, rate)
            cuts.append(K.detect_cutoff(freq, db, rate))
            energies.append(K.hf_energy(freq, mag))
    cutoff = min(cuts, default=0.0)
    loud = np.flatnonzero(np.abs(x).mean(axis=1) > 10 ** (-60 / 20)) if read else np.zeros(0)
    lead, trail = (loud[0] / rate, (read - 1 - loud[-1]) / rate) if len(loud) else (seconds, 0.0)
    first = x[:10_000, 0] * 32768 if read else np.zeros(0)
    middle = m[max(0, (read - 30 * rate) // 2) :][: 30 * rate]
    tape = K.tape(middle, rate, cutoff) if cutoff < 19_000 and read else (None, None, None)
    return (
        path, length, rate, depth, x.shape[1], total / rate, total, read, encoder, error, cutoff, min(energies, default=0.0), float(np.std(cuts)) if len(cuts) > 1 else 0.0,
        int((np.abs(x) >= 0.99).sum()), float(x.mean()) if read else 0.0, float(lead), float(trail), not len(loud), bool((np.abs(first - np.rint(first)) < 1e-4).all()), bool(~np.isfinite(x).all()), *tape, retries,
    )


def per_file(files: DataFrame, f: Callable[..., tuple], schema: str, failed: Callable[..., tuple], setup: Callable[[], tuple] = tuple) -> DataFrame:
    """One row a file by f(*columns, *setup()), one file at a time; what damage raises gives failed(path, length, message). setup runs once a task."""
    ship_code(files.sparkSession)
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = setup()
        for b in batches:
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in b.columns]
                try:
                    out = f(*row, *more)
                except DAMAGE as e:
                    out = failed(row[0], row[1], f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([pa.array([v], TYPES[t]) for v, (_, t) in zip(out, fields, strict=True)], [n for n, _ in fields])

    return files.mapInArrow(run, schema)


def spread(files: DataFrame) -> DataFrame:
    """Deals files (with length) to tasks of about TASK_BYTES: a table of paths is small, what it names is not."""
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    return files.repartition(max(total // TASK_BYTES + 1, files.sparkSession.sparkContext.defaultParallelism), "path")


def failed_measure(path: str, length: int, message: str) -> tuple:
    return (path, length, *[None] * 7, message, *[None] * 14)


def extras(path: str, length: int, cutoff: float, probability: Callable[[np.ndarray], float] | None = None) -> tuple:
    """What R7, R9 and R12 read."""
    (x, rate, *_), _ = load(path)
    ratio = K.silence_ratio(x, rate)[0] if 19_000 <= cutoff <= 21_500 else None
    vinyl, noise, corr, rate_of_clicks = False, None, None, None
    if ratio is not None and 0.15 <= ratio <= 0.3:
        vinyl, noise, corr = K.vinyl_details(x, rate, cutoff)
        rate_of_clicks = K.clicks(x, rate)[1] if vinyl else None
    p = None
    if probability is not None:
        m = K.mono(x)
        size = 10 * rate
        start = max(0, len(m) - size) // 2
        p = float(probability(K.normalise(K.mel_db(K.resample(m[start : start + size], rate, 44_100)))))
    return path, ratio, bool(vinyl), rate_of_clicks, noise, corr, K.preecho(x, rate)[0], K.aliasing(x, rate), K.mp3_pattern(x, rate), p


def segment_cutoff(path: str, data: bytes, start: float, seconds: float) -> tuple[float, float]:
    """Cutoff and high-frequency energy of one segment, of which only its frames are decoded."""
    head = decode(path, data, 0, 1)
    rate = head[1]
    part = K.mono(decode(path, data, int(start * rate), int(seconds * rate))[0])
    freq, mag, db = K.spectrum(part, rate)
    return K.detect_cutoff(freq, db), K.hf_energy(freq, mag)


def segment_cutoffs(path: str, length: int, duration: float) -> tuple:
    """Cutoff spread and the cutoffs of segments, in two steps."""
    data = source.read_bytes(path)

    def at(share: float) -> float:
        return segment_cutoff(path, data, max(0.0, min(duration * share - 5.0, duration - 10.0)), min(10.0, duration))[0]

    cuts = [at(0.05), at(0.95)]
    if 500 <= np.std(cuts) <= 1000:
        cuts[1:1] = [at(0.25), at(0.5), at(0.75)]
    return path, float(np.std(cuts)), cuts


def segment_rows(segments: DataFrame) -> DataFrame:
    """path, start, seconds, cutoff, energy of planned segments (path, length, start and seconds in seconds); cutoff is null where nothing can be decoded."""

    def one(path: str, length: int, start: float, seconds: float) -> tuple:
        try:
            return path, start, seconds, *segment_cutoff(path, source.read_bytes(path), start, seconds)
        except DAMAGE:
            return path, start, seconds, None, None

    return per_file(segments.select("path", "length", F.col("start").cast("double"), F.col("seconds").cast("double")), one, "path string, start double, seconds double, cutoff double, energy double", lambda p, n, e: (p, *[None] * 4))


def sample_blocks(files: DataFrame, size: int = 16_384) -> DataFrame:
    """path, start, rate, channels, samples (interleaved) of blocks of `size` frames of FLAC and WAV files (path), decoded as they are asked for.

    A task holds a file's bytes and one batch of decoded frames, not all samples. Where a stream is damaged its blocks end.
    """
    ship_code(files.sparkSession)

    def blocks(path: str) -> Iterator[tuple[int, int, np.ndarray]]:
        data, held, at = source.read_bytes(path), [], 0
        if path.lower().endswith(".wav"):
            while len(part := wav.read_wav(data, at, size)[0]):
                yield at, wav.read_wav(data, 0, 0)[1], part
                at += len(part)
            return
        head = flac.read_header(data)
        scale = float(1 << (head.bit_depth - 1))
        try:
            for _, x in flac.frames(data, head):
                held.append(x)
                while sum(map(len, held)) >= size:
                    joined = np.concatenate(held)
                    yield at, head.sample_rate, joined[:size] / scale
                    at, held = at + size, [joined[size:]]
        except flac.Broken:
            pass
        if sum(map(len, held)):
            yield at, head.sample_rate, np.concatenate(held) / scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    for start, rate, x in blocks(path):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([rate], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64()))], ["path", "start", "rate", "channels", "samples"])
                except DAMAGE:
                    continue

    return files.select("path").mapInArrow(run, "path string, start long, rate int, channels int, samples array<double>")


def analyze(spark: SparkSession, paths: list[str], sample_seconds: float = SAMPLE_SECONDS, model: Model | None = None) -> DataFrame:
    """Result rows (report.RESULT) of all audio files below the paths: FLAC and WAV decoded, other audio as constant rows.

    Paths that do not exist are left out. model: see Model; without one rule 12 is silent.
    """
    found, _ = scan.existing(spark, paths)
    if not found:
        return spark.createDataFrame([], report.RESULT)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(found).select("path", "length")
    audio = files.where(F.col("path").rlike(r"(?i)\.(flac|wav)$"))
    seen = materialise(per_file(spread(audio), lambda p, n: measure(p, n, sample_seconds), MEASURES, failed_measure), "measures")
    broken = F.col("rate").isNull()
    rows = seen.where(~broken).withColumn("container", R.real_bitrate(F.col("length"), F.col("duration")))
    heard = (F.col("cutoff"), F.col("std"), F.col("hiss_db"), F.col("hiss_corr"), F.col("slope"), F.lit(False))
    rows = rows.withColumns({"cassette": R.rule11(*heard), "cassette_reasons": W.rule11(*heard)})
    more_fields = "path string, ratio double, vinyl boolean, clicks double, noise_db double, noise_corr double, preecho double, aliasing double, pattern boolean, probability double"

    def with_extras(open_rows: DataFrame) -> DataFrame:
        again = spread(open_rows.select("path", "length", "cutoff"))
        more = per_file(again, extras, more_fields, lambda p, n, e: (p, *[None] * 9), (lambda: (model(),)) if model else tuple)
        return open_rows.join(materialise(more, "extras"), "path")

    def with_segments(scored: DataFrame) -> DataFrame:
        again = spread(scored.where((F.col("score") > 30) & (F.col("score") < scoring.CERTAIN)).select("path", "length", "duration"))
        found = materialise(per_file(again, segment_cutoffs, "path string, segment_std double, cutoffs array<double>", lambda p, n, e: (p, None, None)), "segments")
        met = scored.join(found, "path", "left")
        bad = F.size(F.filter("cutoffs", lambda c: R.segment_problem(c, F.col("container"), F.col("rate"))))
        return met.withColumn("problematic", F.when(F.col("cutoffs").isNotNull(), bad).otherwise(0)).withColumn("segment_std", F.coalesce("segment_std", F.lit(0.0)))

    scored = scoring.live(rows, with_extras, with_segments)
    name = F.element_at(F.split("path", "/"), -1)
    pct = F.col("clipped") / F.greatest("frames_read", F.lit(1)) * 100
    both = F.when(F.col("silent"), "full_silence").when((F.col("leading") > 2) & (F.col("trailing") > 2), "both").when(F.col("leading") > 2, "leading").when(F.col("trailing") > 2, "trailing").otherwise("none")
    corrupted, partial = quality.corruption(F.col("frames_read"), F.col("total_frames"), F.col("error"), F.col("bad_values"), R.temporary_error(F.coalesce("error", F.lit(""))))
    real = F.col("frames_read") / F.col("rate")
    gap = R.duration_gap(F.col("duration"), real, F.col("rate"))
    depth = F.when(F.col("depth") <= 16, F.col("depth")).when(F.col("whole16"), 16).otherwise(24)
    original = quality.original_rate(F.col("rate"), F.col("cutoff"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    lost = F.lower("error").contains("lost sync")
    kind = F.when(lost, "decoder_sync_lost").when(partial, "partial_read").otherwise("read_failed")
    issue = F.when(F.col("error").isNotNull(), F.array(F.struct(kind.alias("issue_type"), F.col("error").alias("message"), "frames_read", "total_frames", F.col("retries").alias("retry_count"), now)))
    good = scored.select(
        F.col("path").alias("filepath"), name.alias("filename"), "score", "verdict", "confidence", "reason", F.col("cutoff").alias("cutoff_freq"), F.col("rate").alias("sample_rate"), F.col("depth").alias("bit_depth"),
        F.coalesce("encoder", F.lit("Unknown")).alias("encoder"), F.when(gap > DURATION_TOLERANCE, F.format_string("Durations differ by %d samples", gap)).alias("duration_mismatch"),
        F.format_string("%.3fs", "duration").alias("duration_metadata"), F.format_string("%.3fs", real).alias("duration_real"), gap.alias("duration_diff"),
        (pct > 0.01).alias("has_clipping"), quality.clipping_severity(pct).alias("clipping_severity"), F.bround(pct, 4).alias("clipping_percentage"),
        (F.abs("mean") >= 0.001).alias("has_dc_offset"), quality.dc_severity(F.abs("mean")).alias("dc_offset_severity"), F.bround("mean", 6).alias("dc_offset_value"),
        corrupted.alias("is_corrupted"), F.when(corrupted, F.col("error")).alias("corruption_error"), partial.alias("partial_analysis"), partial.alias("is_partial_analysis"),
        (both != "none").alias("has_silence_issue"), both.alias("silence_issue_type"), ((F.col("depth") > 16) & F.col("whole16")).alias("is_fake_high_res"), depth.cast("int").alias("estimated_bit_depth"),
        (original > 0).alias("is_upsampled"), original.alias("suspected_original_rate"), R.signature_bitrate(F.col("cutoff")).alias("estimated_mp3_bitrate"), issue.alias("issues"),
    )
    dead = seen.where(broken).select(
        F.col("path").alias("filepath"), name.alias("filename"), F.lit(0).alias("score"), F.lit("ERROR").alias("verdict"), F.lit("N/A").alias("confidence"), F.concat(F.lit("Error: "), "error").alias("reason"), F.lit(0.0).alias("cutoff_freq"),
        F.lit("Error").alias("duration_mismatch"), F.lit(True).alias("is_corrupted"), F.col("error").alias("corruption_error"),
        F.array(F.struct(F.lit("read_failed").alias("issue_type"), F.col("error").alias("message"), F.lit(None).cast("long").alias("frames_read"), F.lit(None).cast("long").alias("total_frames"), F.lit(0).alias("retry_count"), now)).alias("issues"),
    )
    other = report.other_audio_rows(scan.classify(files.select("path")).where("kind = 'other_audio'").withColumn("filepath", F.col("path")))
    shape = spark.createDataFrame([], report.RESULT)
    return shape.unionByName(good.unionByName(dead, allowMissingColumns=True).unionByName(other, allowMissingColumns=True), allowMissingColumns=True).select(shape.columns)

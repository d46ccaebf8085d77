"""Repairs as rows: what is wrong with files, new streams from what can be decoded, and how it went. Nothing here replaces a user's file:
the new streams are written to a folder of their own (sources.sinks.write_bytes)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.constants import DURATION_TOLERANCE
from ..sources import files as source
from ..sources import flac, wav
from .analysis import per_file

CHECKED = "path string, n_bytes long, has_mismatch boolean, diff_samples long, diff_ms double, sample_rate int, error string"
REPAIRED = "path string, n_bytes long, success boolean, skipped boolean, message string, samples long, content binary"


def gap(data: bytes, tolerance: int = DURATION_TOLERANCE) -> tuple[bool, int, float, int, str | None]:
    """Whether header and stream differ by more samples than is tolerated, the difference in samples and ms, the rate, and what stopped the decoder."""
    x, head, error = flac.read_flac(data)
    diff = abs(head.total_frames - len(x))
    return diff > tolerance, diff, diff / head.sample_rate * 1000, head.sample_rate, error


def check(files: DataFrame, tolerance: int = DURATION_TOLERANCE) -> DataFrame:
    """CHECKED of FLAC files (path, length)."""
    return per_file(files.select("path", "length"), lambda p, n: (p, n, *gap(source.read_bytes(p), tolerance)), CHECKED, lambda p, n, e: (p, n, False, None, None, None, e))


def repaired(files: DataFrame, tolerance: int = DURATION_TOLERANCE, dry_run: bool = False) -> DataFrame:
    """REPAIRED of FLAC files (path, length): files without fault are skipped; the others are encoded anew from every frame that can be decoded,
    with their tags and pictures, and checked again. content is null where there is nothing to write."""

    def one(path: str, length: int) -> tuple:
        data = source.read_bytes(path)
        wrong, *_, error = gap(data, tolerance)
        if not wrong and error is None:
            return path, length, False, True, "No issue detected", None, None
        if dry_run:
            return path, length, True, False, "Dry run - no modification", None, None
        made = flac.repair(data)
        if made is None:
            return path, length, False, False, "Re-encoding error", None, None
        if gap(made[0], tolerance)[0]:
            return path, length, False, False, "Issue persists after repair", None, None
        return path, length, True, False, "Repaired successfully", made[1], made[0]

    return per_file(files.select("path", "length"), one, REPAIRED, lambda p, n, e: (p, n, False, False, f"Extraction error: {e}", None, None))


def reencoded(files: DataFrame) -> DataFrame:
    """REPAIRED of FLAC and WAV files (path, length), encoded as FLAC; tags and pictures stay."""

    def one(path: str, length: int) -> tuple:
        data = source.read_bytes(path)
        if path.lower().endswith(".wav"):
            x, rate, depth, _ = wav.read_wav(data)
            out = flac.write_flac(x, rate, max(depth, 8))
        else:
            x, head, error = flac.read_flac(data)
            if error:
                return path, length, False, False, error, len(x), None
            out = flac.write_flac(x, head.sample_rate, head.bit_depth, head.tags, head.vendor or "sonolake", pictures=head.pictures)
        return path, length, True, False, "ok", len(x), out

    return per_file(files.select("path", "length"), one, REPAIRED, lambda p, n, e: (p, n, False, False, e, None, None))


def trimmed(plan: DataFrame) -> DataFrame:
    """REPAIRED of planned cuts (path, length, start and seconds in seconds; see segments.trim_plan): the cut of each file as FLAC."""

    def one(path: str, length: int, start: float, seconds: float) -> tuple:
        data = source.read_bytes(path)
        head = flac.read_header(data)
        x, _, error = flac.read_flac(data, int(start * head.sample_rate), int(seconds * head.sample_rate))
        if not len(x):
            return path, length, False, False, error or "output empty or missing", 0, None
        return path, length, True, False, "ok", len(x), flac.write_flac(x, head.sample_rate, head.bit_depth, head.tags)

    return per_file(plan.select("path", "length", "start", "seconds"), one, REPAIRED, lambda p, n, e: (p, n, False, False, e, None, None))

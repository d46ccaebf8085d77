"""Defaults that a caller may replace, as frozen records; Spark's own settings stay in the session."""

from __future__ import annotations

from dataclasses import dataclass

from .functions import constants as C
from .functions import kernels as K


@dataclass(frozen=True)
class AnalysisConfig:
    """Seconds of a sample, and files of a checkpoint. Parallelism is Spark's."""

    sample_duration: float = C.SAMPLE_SECONDS
    save_interval: int = C.CHECKPOINT_FILES


@dataclass(frozen=True)
class ScoringConfig:
    """Fixed values of the earlier scale: least scores of its verdicts, and penalties."""

    authentic_threshold: int = 90
    probably_authentic_threshold: int = 70
    suspect_threshold: int = 50
    penalty_low_energy: int = 30
    penalty_duration_mismatch: int = 20
    penalty_suspicious_metadata: int = 10


@dataclass(frozen=True)
class SpectralConfig:
    """The cutoff search, in Hz, dB and slices."""

    reference_freq_low: int = K.REF_LOW
    reference_freq_high: int = K.REF_HIGH
    cutoff_scan_start: int = K.SCAN_FROM
    slice_size: int = K.SLICE_HZ
    cutoff_threshold_db: float = K.DROP_DB
    consecutive_low_threshold: int = 2
    high_freq_threshold: int = 16_000


@dataclass(frozen=True)
class RepairConfig:
    """Level, backup, tolerance in samples and seconds a re-encoding may take."""

    flac_compression_level: int = 5
    backup_enabled: bool = True
    duration_tolerance_samples: int = C.DURATION_TOLERANCE
    reencode_timeout: int = 300

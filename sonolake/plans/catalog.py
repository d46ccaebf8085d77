"""All queries of the audio-provenance operators, and the SQL that gives the same rows."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import queries_signal, queries_dataset, queries_report, queries_scoring  # noqa: F401  each registers its queries

__all__ = ["ORACLES", "QUERIES"]

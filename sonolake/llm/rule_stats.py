"""Counts that quality rules are made of, for whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, text_bytes

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
SPACES = b" \t\n\r\x0b\x0c"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    a = np.fromiter([names.setdefault(w, len(names)) for w in words], np.int64, len(words))
    k = len(names)
    if k < 2_000_000:
        key = (a[:-2] * k + a[1:-1]) * k + a[2:]
    else:
        _, two = np.unique(a[:-1] * k + a[1:], return_inverse=True)
        key = two[:-1] * k + a[2:]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = n[at] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : len(words) - 2 + i] |= hit
    return int(covered.sum())


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    chars = sum(map(len, words)) - len(raw.translate(None, bytes(c for c in range(256) if not 128 <= c < 192)))
    return len(words), chars, len(raw.translate(None, NOT_SYMBOLS)), repeated_lines(raw), repeated_words(words)


def rule_stats(docs: DataFrame) -> DataFrame:
    """doc_id and BASE; a null text has no words."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [base_counts(raw, raw.split()) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", *BASE])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *BASE]))

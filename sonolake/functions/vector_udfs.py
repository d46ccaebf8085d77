"""Array kernels over columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship_code
from . import kernels as K


def spectra(frames: DataFrame) -> DataFrame:
    """vec_id, mag: magnitudes of the Hann-windowed frame."""
    ship_code(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mag = [K.spectrum(np.asarray(x), 1.0)[1].tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mag, pa.list_(pa.float64()))], ["vec_id", "mag"])

    return frames.select("vec_id", "samples").mapInArrow(run, "vec_id long, mag array<double>")


def mapped(rows: DataFrame, key: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, values: f of each row's samples."""
    ship_code(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.asarray(f(np.asarray(x, float)), float).tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.list_(pa.float64()))], [key, "values"])

    return rows.select(key, "samples").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, values array<double>")


def cutoff_bins(frames: DataFrame, ref_low: int, ref_high: int, width: int, drop_db: float) -> DataFrame:
    """As operators.signal_sql.cutoff_bins over dft, one frame at a time."""
    ship_code(frames.sparkSession)

    def one(x: np.ndarray) -> int:
        db = K.spectrum(x, 1.0)[2]
        limit = np.median(db[ref_low : ref_high + 1]) - drop_db
        low = [bool(np.percentile(db[a : a + width], 75) < limit) for a in range(ref_high, len(db), width)]
        both = [i for i in range(len(low) - 1) if low[i] and low[i + 1]]
        return both[0] * width + ref_high if both else len(db) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(np.asarray(x)) for x in b.column(1).to_pylist()], pa.int64())], ["vec_id", "cutoff_bin"])

    return frames.select("vec_id", "samples").mapInArrow(run, "vec_id long, cutoff_bin long")


def artifact_features(rows: DataFrame, key: str, rate: int, cutoff: float = 16_000.0) -> DataFrame:
    """Features that R7, R9 and R11 read, of each row's samples."""
    ship_code(rows.sparkSession)
    columns = "preecho double, aliasing double, pattern boolean, vinyl boolean, noise_db double, clicks double, hiss_db double, hiss_corr double, slope double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in (np.asarray(v, float) for v in b.column(1).to_pylist()):
                vinyl, noise = K.vinyl_noise(x, rate, cutoff)
                out.append((K.preecho(x, rate)[0], K.aliasing(x, rate), K.mp3_pattern(x, rate), bool(vinyl), noise, K.clicks(x, rate)[1], *K.tape(x, rate, cutoff)))
            types = [pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), *[pa.float64()] * 5]
            names = [c.split()[0] for c in columns.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], [key, *names])

    return rows.select(key, "samples").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {columns}")


def mel_means(frames: DataFrame, rate: int) -> DataFrame:
    """vec_id, mel: mean dB of each mel band."""
    ship_code(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mel = [K.mel_db(np.asarray(x), rate, seconds=0.05).mean(1).tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mel, pa.list_(pa.float64()))], ["vec_id", "mel"])

    return frames.select("vec_id", "samples").mapInArrow(run, "vec_id long, mel array<double>")

"""PCM in RIFF/WAVE files."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np


def read_wav(data: bytes, start: int = 0, frames: int | None = None) -> tuple[np.ndarray, int, int, int]:
    """(frames, channels) in [-1, 1) of a slice of frames; sample rate, bit depth and frames of the whole file."""
    with wave.open(io.BytesIO(data)) as w:
        if not w.getframerate():
            raise ValueError("a sample rate of 0")
        rate, width, channels, total = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.getnframes()
        w.setpos(min(start, total))
        raw = w.readframes(max(0, min(total - start, frames if frames is not None else total)))
    if width == 3:
        bytes3 = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        ints = ((bytes3[:, 0] | (bytes3[:, 1] << 8) | (bytes3[:, 2] << 16)) << 8) >> 8
    elif width == 1:
        ints = np.frombuffer(raw, np.uint8).astype(np.int32) - 128
    else:
        ints = np.frombuffer(raw, "<i2" if width == 2 else "<i4").astype(np.int64)
    return (ints / float(1 << (8 * width - 1))).reshape(-1, channels), rate, 8 * width, total


def write_wav(x: np.ndarray, rate: int, depth: int = 16) -> bytes:
    top = (1 << (depth - 1)) - 1
    ints = np.clip(np.rint(np.atleast_2d(x.T).T * (top + 1)), -top - 1, top).astype("<i4")
    raw = ints.astype("<i2").tobytes() if depth == 16 else b"".join(struct.pack("<i", v)[:3] for v in ints.ravel().tolist())
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(ints.shape[1])
        w.setsampwidth(depth // 8)
        w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()

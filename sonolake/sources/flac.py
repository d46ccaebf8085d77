"""FLAC streams, read by the public format specification (RFC 9639): header blocks, tags, pictures and samples.

Decoding is array work but for one loop: where a Rice code ends has to be known before the next one starts, so that
the codes' stop bits are found one by one in the frame's bits; all else of a residual is cut out at once. Predictors run over
BATCH frames together, sample by sample, each step for all subframes. Slices are found by the frames' own numbers.

The encoder (best fixed predictor of order 0 to 3, one Rice parameter for each of up to 16 parts) re-encodes without outside programs.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np

MARK = b"fLaC"
#: Frames whose predictors run together.
BATCH = 256
#: Sample rates and block sizes by their code in a frame header, and predictor coefficients by order.
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class Broken(ValueError):
    """The stream cannot be decoded from here on."""


@dataclass
class Header:
    sample_rate: int
    channels: int
    bit_depth: int
    total_frames: int
    md5: bytes
    vendor: str | None = None
    tags: dict[str, list[str]] = field(default_factory=dict)
    pictures: list[dict] = field(default_factory=list)
    audio_at: int = 0
    block: int = 4096

    @property
    def duration(self) -> float:
        return self.total_frames / self.sample_rate if self.sample_rate else 0.0


def comments(block: bytes) -> tuple[str, dict[str, list[str]]]:
    n = struct.unpack_from("<I", block)[0]
    vendor, at = block[4 : 4 + n].decode("utf-8", "replace"), 4 + n
    count, at = struct.unpack_from("<I", block, at)[0], at + 4
    tags: dict[str, list[str]] = {}
    for _ in range(count):
        n = struct.unpack_from("<I", block, at)[0]
        if at + 4 + n > len(block):
            raise struct.error("a tag is longer than its block")
        key, _, value = block[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        tags.setdefault(key.upper(), []).append(value)
        at += 4 + n
    return vendor, tags


def picture(block: bytes) -> dict:
    kind, n = struct.unpack_from(">II", block)
    mime, at = block[8 : 8 + n].decode("ascii", "replace"), 8 + n
    n = struct.unpack_from(">I", block, at)[0]
    desc, at = block[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n
    width, height, depth, colors, n = struct.unpack_from(">5I", block, at)
    return {"type": kind, "mime": mime, "desc": desc, "width": width, "height": height, "depth": depth, "colors": colors, "data": block[at + 20 : at + 20 + n]}


def read_header(data: bytes) -> Header:
    if data[:4] != MARK:
        raise Broken("no FLAC marker")
    at, out = 4, None
    while True:
        if at + 4 > len(data):
            raise Broken("unexpected end of the header")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            bits = int.from_bytes(block[10:18], "big")
            out = Header(bits >> 44, (bits >> 41 & 7) + 1, (bits >> 36 & 31) + 1, bits & ((1 << 36) - 1), block[18:34], block=int.from_bytes(block[2:4], "big"))
            if len(block) < 34 or not out.sample_rate:
                raise Broken("invalid stream info")
        elif out and kind & 127 in (4, 6):
            try:
                if kind & 127 == 4:
                    out.vendor, out.tags = comments(block)
                else:
                    out.pictures.append(picture(block))
            except struct.error as e:
                raise Broken("a tag or picture block is cut") from e
        at += 4 + size
        if kind & 128:
            break
    if out is None:
        raise Broken("no stream info")
    out.audio_at = at
    return out


class Window:
    """The bits of a piece of the stream, in the forms that decoding asks for. Places are bits from its start."""

    def __init__(self, data: bytes, at: int, size: int):
        raw = data[at : at + size]
        self.raw, self.bits = raw, 8 * len(raw)
        padded = np.frombuffer(raw + bytes(16), np.uint8)
        self.find = np.unpackbits(padded[: len(raw)]).tobytes().find
        self.rows = np.lib.stride_tricks.sliding_window_view(padded, 8)
        self.pos = 0

    def take(self, n: int) -> int:
        stop = self.pos + n
        if stop > self.bits:
            raise Short
        b = (stop + 7) >> 3
        v = int.from_bytes(self.raw[self.pos >> 3 : b], "big") >> (8 * b - stop) & ((1 << n) - 1)
        self.pos = stop
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        at = self.find(1, self.pos)
        if at < 0:
            raise Short
        n, self.pos = at - self.pos, at + 1
        return n

    def fields(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned fields of up to 56 bits at the given places."""
        words = np.ascontiguousarray(self.rows[at >> 3]).view(">u8")[:, 0].astype(np.uint64)
        width = np.asarray(width, np.uint64)
        return ((words << (at & 7).astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - width)).astype(np.int64)

    def run(self, n: int, width: int) -> np.ndarray:
        """n signed fields of one width, one after another."""
        if self.pos + n * width > self.bits:
            raise Short
        at = self.pos + width * np.arange(n)
        self.pos += n * width
        if not width:
            return np.zeros(n, np.int64)
        v = self.fields(at, width)
        return v - ((v >> (width - 1)) << width)

    def coded_number(self) -> int:
        first = self.take(8)
        extra = 0 if first < 128 else 8 - (first ^ 255).bit_length() - 1
        v = first if first < 128 else first & ((1 << max(0, 6 - extra)) - 1)
        for _ in range(extra):
            v = v << 6 | self.take(8) & 63
        return v


class Short(Exception):
    """The window ends before the frame does."""


def residual(w: Window, n: int, order: int) -> np.ndarray:
    width = 4 + w.take(2)
    parts = 1 << w.take(4)
    if n % parts or n // parts < order:
        raise Broken("invalid frame header: residual parts do not fit the block")
    stops: list[int] = []
    coded: list[tuple[int, int, int]] = []
    pieces: list[np.ndarray] = []
    find = w.find

    def flush() -> None:
        if not stops:
            return
        t = np.array(stops, np.int64)
        k = np.repeat(np.array([c[0] for c in coded]), [c[1] for c in coded])
        starts = np.empty(len(t), np.int64)
        starts[1:] = t[:-1] + 1 + k[:-1]
        firsts = np.cumsum([0] + [c[1] for c in coded[:-1]])
        starts[firsts] = [c[2] for c in coded]
        v = (t - starts) << k | w.fields(t + 1, k)
        pieces.append(v >> 1 ^ -(v & 1))
        stops.clear()
        coded.clear()

    for p in range(parts):
        k, count = w.take(width), n // parts - (order if p == 0 else 0)
        if k == (1 << width) - 1:
            flush()
            pieces.append(w.run(count, w.take(5)))
        elif count:
            coded.append((k, count, w.pos))
            step = k + 1
            q = w.pos - step
            part = [q := find(1, q + step) for _ in repeat(None, count)]
            w.pos = q + step
            if min(part) < 0 or w.pos > w.bits:
                raise Short
            stops += part
    flush()
    return np.concatenate(pieces) if pieces else np.zeros(0, np.int64)


@dataclass
class Subframe:
    """Samples, or what predicts them: warm-up samples, factors (newest sample first), shift and residual."""

    samples: np.ndarray | None
    warm: list[int] = field(default_factory=list)
    factors: list[int] = field(default_factory=list)
    shift: int = 0
    error: np.ndarray | None = None
    waste: int = 0


def subframe(w: Window, n: int, bits: int) -> Subframe:
    if w.take(1):
        raise Broken("lost sync: a subframe's first bit is set")
    kind, waste = w.take(6), 0
    if w.take(1):
        waste = w.zeros() + 1
        bits -= waste
    if bits <= 0:
        raise Broken("invalid frame header: no bits are left of a sample")
    if kind == 0:
        return Subframe(np.full(n, w.signed(bits), np.int64) << waste)
    if kind == 1:
        return Subframe(w.run(n, bits) << waste)
    if 8 <= kind <= 12:
        order, shift, factors = kind - 8, 0, FIXED[kind - 8]
        warm = [w.signed(bits) for _ in range(order)]
    elif kind >= 32:
        order = kind - 31
        warm = [w.signed(bits) for _ in range(min(order, n))]
        precision, shift = w.take(4) + 1, w.signed(5)
        factors = [w.signed(precision) for _ in range(order)]
        if shift < 0:
            raise Broken("invalid frame header: a negative shift")
    else:
        raise Broken("invalid frame header: a reserved subframe type")
    if order > n:
        raise Broken("invalid frame header: a predictor longer than its block")
    error = residual(w, n, order)
    if not order:
        return Subframe(error << waste)
    return Subframe(None, warm, factors, shift, error, waste)


@dataclass
class Frame:
    first: int
    size: int
    layout: int
    subframes: list[Subframe]
    stop: int


def frame_header(data: bytes, at: int, head: Header) -> tuple[int, int, int, int, int] | None:
    """First sample, size, layout, bits a sample and the header's length of the frame at a place; None if there is none."""
    if data[at : at + 1] != b"\xff" or len(data) < at + 5 or data[at + 1] & 0xFE != 0xF8:
        return None
    w = Window(data, at, 20)
    try:
        w.pos = 15
        variable = w.take(1)
        size, rate, layout, depth = w.take(4), w.take(4), w.take(4), w.take(3)
        if w.take(1) or size == 0 or rate == 15 or layout > 10 or depth == 3:
            return None
        number = w.coded_number()
        n = 192 if size == 1 else 576 << (size - 2) if 2 <= size <= 5 else w.take(8) + 1 if size == 6 else w.take(16) + 1 if size == 7 else 256 << (size - 8)
        w.take(8 if rate == 12 else 16 if rate in (13, 14) else 0)
        if w.take(8) != crc(data[at : at + w.pos // 8 - 1], 0x07, 8):
            return None
    except Short:
        return None
    return number if variable else number * head.block, n, layout, DEPTHS.get(depth, head.bit_depth), w.pos // 8


def read_frame(data: bytes, at: int, head: Header, guess: int) -> Frame:
    found = frame_header(data, at, head)
    if found is None:
        raise Broken("lost sync")
    first, n, layout, bits, skip = found
    two = layout in (8, 9, 10)
    while True:
        w = Window(data, at + skip, guess)
        try:
            parts = [subframe(w, n, bits + (two and c == (0 if layout == 9 else 1))) for c in range(2 if two else layout + 1)]
            stop = at + skip + ((w.pos + 7) >> 3) + 2
            return Frame(first, n, layout, parts, stop)
        except Short:
            if at + skip + guess >= len(data):
                raise Broken("unexpected end of the stream") from None
            guess *= 4


def predicted(subframes: list[Subframe]) -> None:
    """Fills in the samples of all subframes that are predicted, those of one length together."""
    by_size: dict[int, list[Subframe]] = {}
    for s in subframes:
        if s.samples is None:
            by_size.setdefault(len(s.warm) + len(s.error), []).append(s)
    for n, group in by_size.items():
        most = max(len(s.warm) for s in group)
        x, factors = np.zeros((n, len(group)), np.int64), np.zeros((most, len(group)), np.int64)
        orders, shift = np.array([len(s.warm) for s in group]), np.array([s.shift for s in group])
        for i, s in enumerate(group):
            x[: orders[i], i], x[orders[i] :, i], factors[: orders[i], i] = s.warm, s.error, s.factors
        for t in range(1, n):
            depth = min(t, most)
            guess = (x[t - depth : t][::-1] * factors[:depth]).sum(0) >> shift
            x[t] += guess if t >= most else np.where(orders <= t, guess, 0)
        for i, s in enumerate(group):
            s.samples = x[:, i] << s.waste


def channels_of(f: Frame) -> np.ndarray:
    x = [s.samples for s in f.subframes]
    if f.layout == 8:
        x[1] = x[0] - x[1]
    elif f.layout == 9:
        x[0] = x[0] + x[1]
    elif f.layout == 10:
        mid = x[0] << 1 | x[1] & 1
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    return np.stack(x, axis=1)


def seek(data: bytes, head: Header, target: int) -> int:
    """Where a frame starts that holds the target sample or an earlier one, by bisection; the first frame's place if nothing better is found.

    A frame is taken for one if its header and the header's checksum are right and its number lies between those around it.
    """
    low, high, first, last = head.audio_at, len(data), 0, head.total_frames or 1 << 40
    marks = (b"\xff\xf8", b"\xff\xf9")
    while high - low > 1 << 16:
        middle, at, found = (low + high) // 2, 0, None
        at = middle - 1
        while found is None:
            places = [p for m in marks if (p := data.find(m, at + 1, high)) >= 0]
            if not places:
                break
            at = min(places)
            found = frame_header(data, at, head)
            if found and not first <= found[0] <= last:
                found = None
        if found is None:
            high = middle
        elif found[0] <= target:
            if at <= low:
                break
            low, first = at, found[0]
        else:
            high, last = middle, found[0]
    return low


def frames(data: bytes, head: Header, start: int = 0, stop: int | None = None):
    """Yields (first sample, (n, channels) integers) of the frames from start to stop; raises Broken where the stream is damaged."""
    at, guess, waiting = (seek(data, head, start) if start else head.audio_at), 1 << 14, []
    error = None
    while at < len(data):
        try:
            f = read_frame(data, at, head, guess)
        except Broken as e:
            error = e
            break
        if stop is not None and f.first >= stop:
            break
        guess, at = 64 + (f.stop - at) * 5 // 4, f.stop
        if f.first + f.size > start:
            waiting.append(f)
        if len(waiting) >= BATCH:
            predicted([s for w in waiting for s in w.subframes])
            yield from ((w.first, channels_of(w)) for w in waiting)
            waiting = []
    predicted([s for w in waiting for s in w.subframes])
    yield from ((w.first, channels_of(w)) for w in waiting)
    if error:
        raise error


def read_flac(data: bytes, start: int = 0, count: int | None = None) -> tuple[np.ndarray, Header, str | None]:
    """(frames, channels) in [-1, 1) of a slice, the header, and what stopped the decoder early, if anything did.

    Of a slice, frames outside it are not decoded.
    """
    head = read_header(data)
    stop = None if count is None else start + count
    got, error = [], None
    try:
        for first, x in frames(data, head, start, stop):
            if x.shape[1] != head.channels:
                raise Broken("invalid frame header: the number of channels changes")
            got.append(x[max(0, start - first) : None if stop is None else max(0, stop - first)])
    except Broken as e:
        error = str(e)
    out = np.concatenate(got) if got else np.zeros((0, head.channels), np.int64)
    return out / float(1 << (head.bit_depth - 1)), head, error


@lru_cache(maxsize=4)
def crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for v in range(256):
        v <<= bits - 8
        for _ in range(8):
            v = (v << 1) ^ (poly if v >> (bits - 1) else 0)
            v &= (1 << bits) - 1
        out.append(v)
    return out


def crc(data: bytes, poly: int, bits: int) -> int:
    v, t, shift, mask = 0, crc_table(poly, bits), bits - 8, (1 << bits) - 1
    for b in data:
        v = (v << 8 & mask) ^ t[v >> shift ^ b]
    return v


def bit_planes(values: np.ndarray, width: int) -> np.ndarray:
    """Fields of one width as bits, one after another."""
    return (values[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).ravel()


def rice_bits(v: np.ndarray, k: int) -> np.ndarray:
    u = np.where(v >= 0, 2 * v, -2 * v - 1)
    size = (u >> k) + 1 + k
    stop = np.cumsum(size) - k - 1
    out = np.zeros(int(size.sum()), np.uint8)
    out[stop] = 1
    for j in range(k):
        out[stop + 1 + j] = u >> (k - 1 - j) & 1
    return out


def encode_subframe(x: np.ndarray, depth: int) -> np.ndarray:
    """The shortest of a constant, a verbatim and the fixed predictors' subframes, as bits."""
    if (x == x[0]).all():
        return np.concatenate([bit_planes(np.array([0]), 8), bit_planes(x[:1], depth)])
    n, options = len(x), [np.concatenate([bit_planes(np.array([2]), 8), bit_planes(x, depth)])]
    e = x
    errors = [e] + [e := np.diff(e) for _ in range(min(3, n - 1))]
    order = min(range(len(errors)), key=lambda i: np.abs(errors[i]).sum())
    parts = 1 << max(p for p in range(5) if n % (1 << p) == 0 and n >> p > order)
    bits = [bit_planes(np.array([(8 + order) << 1]), 8), bit_planes(x[:order], depth), bit_planes(np.array([0]), 2), bit_planes(np.array([parts.bit_length() - 1]), 4)]
    cuts = [0, *(n // parts * (i + 1) - order for i in range(parts))]
    for a, b in zip(cuts, cuts[1:]):
        part = errors[order][a:b]
        k = min(14, max(0, int(np.log2(max(1.0, float(np.abs(part).mean()) * 1.4)))))
        bits += [bit_planes(np.array([k]), 4), rice_bits(part, k)]
    options.append(np.concatenate(bits))
    return min(options, key=len)


def write_flac(x: np.ndarray, rate: int, depth: int = 16, tags: dict[str, list[str]] | None = None, vendor: str = "sonolake", block: int = 4096, pictures: list[dict] | None = None) -> bytes:
    """x: (frames, channels) in [-1, 1)."""
    ints = np.clip(np.rint(np.atleast_2d(x.T).T * (1 << (depth - 1))), -(1 << (depth - 1)), (1 << (depth - 1)) - 1).astype(np.int64)
    n, channels = ints.shape
    info = struct.pack(">HH", block, block) + bytes(6) + ((rate << 44) | (channels - 1) << 41 | (depth - 1) << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm(ints, depth)).digest()
    fields = [f"{k}={v}".encode() for k, vs in (tags or {}).items() for v in vs]
    note = struct.pack("<I", len(vendor.encode())) + vendor.encode() + struct.pack("<I", len(fields)) + b"".join(struct.pack("<I", len(f)) + f for f in fields)
    blocks = [(0, info), (4, note), *((6, picture_block(p)) for p in pictures or [])]
    out = [MARK, *(bytes([kind | 0x80 * (i == len(blocks) - 1)]) + len(b).to_bytes(3, "big") + b for i, (kind, b) in enumerate(blocks))]
    code = next(k for k, v in DEPTHS.items() if v == depth)
    for number, a in enumerate(range(0, n, block)):
        part = ints[a : a + block]
        head = bytes([0xFF, 0xF8, 0x70, (channels - 1) << 4 | code << 1]) + chr(number).encode("utf-8", "surrogatepass") + (len(part) - 1).to_bytes(2, "big")
        body = np.packbits(np.concatenate([encode_subframe(part[:, c], depth) for c in range(channels)])).tobytes()
        frame = head + bytes([crc(head, 0x07, 8)]) + body
        out.append(frame + crc(frame, 0x8005, 16).to_bytes(2, "big"))
    return b"".join(out)


def pcm(ints: np.ndarray, depth: int) -> bytes:
    """Interleaved little-endian samples, of which the header's MD5 is made."""
    size = (depth + 7) // 8
    return ints.astype("<i8").ravel().view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def picture_block(p: dict) -> bytes:
    mime, desc = p["mime"].encode(), p["desc"].encode()
    return struct.pack(">II", p["type"], len(mime)) + mime + struct.pack(">I", len(desc)) + desc + struct.pack(">5I", p["width"], p["height"], p["depth"], p["colors"], len(p["data"])) + p["data"]


def repair(data: bytes) -> tuple[bytes, int] | None:
    """A stream anew from what can be decoded, with its tags and pictures, and how many samples it has; None if nothing can.

    Damaged frames are left out: decoding goes on at the next frame whose header is right.
    """
    head = read_header(data)
    at, got = head.audio_at, []
    while 0 <= at < len(data):
        try:
            f = read_frame(data, at, head, 1 << 16)
            predicted(f.subframes)
            x = channels_of(f)
            if x.shape[1] == head.channels and crc(data[at : f.stop - 2], 0x8005, 16) == int.from_bytes(data[f.stop - 2 : f.stop], "big"):
                got.append(x)
                at = f.stop
                continue
        except Broken:
            pass
        places = [p for m in (b"\xff\xf8", b"\xff\xf9") if (p := data.find(m, at + 1)) >= 0]
        at = min(places, default=-1)
    if not got:
        return None
    x = np.concatenate(got) / float(1 << (head.bit_depth - 1))
    return write_flac(x, head.sample_rate, head.bit_depth, head.tags, head.vendor or "sonolake", pictures=head.pictures), len(x)

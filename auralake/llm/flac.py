"""Operator 6: FLAC streams, written from 8-bit mono samples and read of any kind.

Writing, and reading of streams like those that are written, works on all frames of a batch at once:
a numpy step handles the n-th residual (or byte, for checksums) of every frame. Such a stream has
STREAMINFO with the MD5 of its samples, a seek table with a point for each frame, and frames of
``BLOCK`` samples (the last one shorter). A frame's subframe is constant, verbatim, a fixed predictor
of order 0 to 2, or a linear predictor of order 2 with quantised coefficients, whichever takes fewest
bits; residuals are Rice-coded.

All other streams are read frame by frame, each from where the last one ends, with or without a seek
table: 4 to 32 bits, up to 8 channels, stereo as sides and middle, wasted bits, blocks of fixed or
variable size, all predictors, and Rice parameters of four or five bits. Either way the CRC-8 and
CRC-16 of each frame and the MD5 of the samples are checked. PCM has a byte a sample up to 8 bits
(128 is silence), and signed little-endian numbers above, channels side by side.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 1024
RATE = 8000
#: Bits of a linear predictor's coefficients, and their shift.
PRECISION, SHIFT = 10, 8
PAD = 64
#: Bytes of payload that are coded at once; the arrays of a step are about 100 times that.
STEP_BYTES = 1 << 20
# The coefficients of the format's fixed predictors, by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each stretch of ``data``."""
    order = np.argsort(start - end, kind="stable")
    at, left = start[order].copy(), (end - start)[order]
    crc = np.zeros(len(at), np.uint32)
    for i in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -i, "left"))
        own = crc[:n]
        crc[:n] = (own << 8 ^ table[own >> (bits - 8) ^ data[at[:n] + i]]) & ((1 << bits) - 1)
    out = np.empty_like(crc)
    out[order] = crc
    return out


@lru_cache(200_000)
def _frame_header(number: int, size: int) -> bytes:
    """Sync code to CRC-8 of a mono frame of 8-bit samples."""
    if number < 0x80:
        coded = bytes([number])
    else:
        tail = []
        while not tail or number >= 1 << (6 - len(tail)):
            tail.append(0x80 | number & 0x3F)
            number >>= 6
        coded = bytes([0xFF << (7 - len(tail)) & 0xFF | number, *reversed(tail)])
    head = bytes([0xFF, 0xF8, (0xA0 if size == BLOCK else 0x70) | 0x4, 0x02]) + coded + (b"" if size == BLOCK else struct.pack(">H", size - 1))
    crc = 0
    for b in head:
        crc = int(_CRC8[crc ^ b])
    return head + bytes([crc])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    """Writes ``width`` bits of each value, highest first, and moves ``at``."""
    for b in range(width - 1, -1, -1):
        bits[at] = value >> b & 1
        at += 1


def _predictors(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order-2 linear prediction by least squares for each frame: quantised coefficients, and residuals of kinds 0 to 3."""
    frames = x.astype(np.float32)
    r0 = np.einsum("ij,ij->i", frames, frames).astype(np.float64)
    r1 = np.einsum("ij,ij->i", frames[:, 1:], frames[:, :-1]).astype(np.float64)
    r2 = np.einsum("ij,ij->i", frames[:, 2:], frames[:, :-2]).astype(np.float64)
    det = r0 * r0 - r1 * r1
    safe = np.where(det > 1e-6 * r0 * r0, det, 1.0)
    a = np.where(det > 1e-6 * r0 * r0, r1 * (r0 - r2) / safe, 0.0)
    b = np.where(det > 1e-6 * r0 * r0, (r0 * r2 - r1 * r1) / safe, 0.0)
    most = (1 << PRECISION - 1) - 1
    coefs = np.clip(np.rint(np.stack([a, b], 1) * (1 << SHIFT)), -most, most).astype(np.int32)
    out = np.zeros((4, *x.shape), np.int32)
    out[0] = x
    out[1][:, 1:] = x[:, 1:] - x[:, :-1]
    out[2][:, 2:] = x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]
    out[3][:, 2:] = x[:, 2:] - (coefs[:, :1] * x[:, 1:-1] + coefs[:, 1:] * x[:, :-2] >> SHIFT)
    inside = np.arange(x.shape[1]) < length[:, None]
    out *= inside
    return coefs, out, inside


_ORDER = np.array([0, 1, 2, 2])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; a byte is a sample, 128 is silence. No payload is empty."""
    sizes = np.array([len(p) for p in payloads])
    per = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    begin = (np.cumsum(sizes) - sizes)[owner] + number * BLOCK
    place = np.minimum(begin[:, None] + np.arange(BLOCK), len(flat) - 1)
    x = (flat[place].astype(np.int32) - 128) * (np.arange(BLOCK) < length[:, None])
    coefs, kinds, inside = _predictors(x, length)
    best = np.full(len(owner), 1 << 30)
    kind, rice = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    for i in range(4):
        order = int(_ORDER[i])
        u = (kinds[i] << 1 ^ kinds[i] >> 31)
        u[:, :order] = 0
        head = 8 + 8 * order + (9 + PRECISION * order if i == 3 else 0) + 10
        usual = np.log2(np.maximum(u.sum(1) / np.maximum(length - order, 1), 1)).astype(np.int64)
        for k in (usual, np.maximum(usual - 1, 0)):
            cost = (u >> k[:, None]).sum(1) + (length - order) * (k + 1) + head
            better = cost < best
            best[better], kind[better], rice[better] = cost[better], i, k[better]
    same = (((x == x[:, :1]) | ~inside).all(1)) & (length > 0)
    verbatim = ~same & (best >= 8 + 8 * length)
    bit_size = np.where(same, 16, np.where(verbatim, 8 + 8 * length, best))
    heads = [_frame_header(n, s) for n, s in zip(number.tolist(), length.tolist(), strict=True)]
    head_size = np.array([len(h) for h in heads])
    frame_size = head_size + -(-bit_size // 8) + 2
    frame_at = np.cumsum(frame_size) - frame_size
    bits = np.zeros(8 * int(frame_size.sum()), np.uint8)
    at = 8 * (frame_at + head_size)
    coded = ~same & ~verbatim
    mine = np.flatnonzero(same)
    if len(mine):
        a = at[mine] + 8
        _put(bits, a, x[mine, 0] & 0xFF, 8)
    mine = np.flatnonzero(verbatim)
    if len(mine):
        a = at[mine]
        _put(bits, a, np.full(len(mine), 2), 8)
        row, column = np.nonzero(inside[mine])
        a = a[row] + 8 * column
        _put(bits, a, x[mine[row], column] & 0xFF, 8)
    for i in range(4):
        mine = np.flatnonzero(coded & (kind == i))
        if not len(mine):
            continue
        order, a, k = int(_ORDER[i]), at[mine], rice[mine]
        _put(bits, a, np.full(len(mine), (8 + order if i < 3 else 32 + order - 1) << 1), 8)
        for j in range(order):
            _put(bits, a, x[mine, j] & 0xFF, 8)
        if i == 3:
            _put(bits, a, np.full(len(mine), (PRECISION - 1) << 5 | SHIFT), 9)
            for j in range(order):
                _put(bits, a, coefs[mine, j] & ((1 << PRECISION) - 1), PRECISION)
        _put(bits, a, k, 10)
        r = kinds[i][mine][:, order:]
        u = r << 1 ^ r >> 31
        q = u >> k[:, None]
        use = inside[mine][:, order:]
        width = np.where(use, q + 1 + k[:, None], 0)
        stop = a[:, None] + np.cumsum(width, 1) - width + q
        u, stop, each_k = u[use], stop[use], np.broadcast_to(k[:, None], use.shape)[use]
        bits[stop] = 1
        for j in range(int(k.max())):
            low = each_k > j
            bits[stop[low] + 1 + j] = u[low] >> (each_k[low] - 1 - j) & 1
    data = np.packbits(bits)
    head_flat = np.frombuffer(b"".join(heads), np.uint8)
    data[np.repeat(frame_at - (np.cumsum(head_size) - head_size), head_size) + np.arange(len(head_flat))] = head_flat
    end = frame_at + frame_size - 2
    crc = _crc(data, frame_at, end, _CRC16, 16)
    data[end], data[end + 1] = crc >> 8, crc & 0xFF
    out, raw, first = [], data.tobytes(), np.cumsum(per) - per
    signed = (flat ^ 0x80).tobytes()
    offset = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    for i, (a, n) in enumerate(zip(first.tolist(), per.tolist(), strict=True)):
        start, stop = int(frame_at[a]), int(frame_at[a + n - 1] + frame_size[a + n - 1])
        md5 = hashlib.md5(signed[offset[i] : offset[i + 1]], usedforsecurity=False).digest()
        own = frame_size[a : a + n]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | int(sizes[i])).to_bytes(8, "big") + md5
        points = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = np.arange(n) * BLOCK, frame_at[a : a + n] - start, length[a : a + n]
        out.append(b"".join([b"fLaC\x00\x00\x00\x22", info, b"\x83", (18 * n).to_bytes(3, "big"), points.tobytes(), raw[start:stop]]))
    return out


class Damaged(ValueError):
    """A stream that is no whole FLAC stream, or whose checksums do not hold."""


def _opened(data: bytes) -> tuple[int, int, bytes, np.ndarray]:
    """Of a stream: its first frame's offset, its samples, their MD5, and its seek points (sample, offset, n)."""
    if data[:4] != b"fLaC":
        raise Damaged("no FLAC marker")
    at, samples, md5, points = 4, 0, b"", None
    while True:
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7 or packed >> 36 & 31 != 7:
                raise Damaged("not 8-bit mono")
            samples, md5 = packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        last, at = data[at] & 0x80, at + 4 + size
        if last:
            break
    if points is None or int(points["n"].sum()) != samples:
        raise Damaged("no seek point for each frame")
    return at, samples, md5, points


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream; Damaged if a header, a frame's checksum or the MD5 does not hold."""
    opened = [_opened(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    data = np.frombuffer(b"".join(streams) + bytes(PAD), np.uint8)
    per = np.array([len(o[3]) for o in opened])
    start = np.concatenate([b + o[0] + o[3]["offset"].astype(np.int64) for b, o in zip(base.tolist(), opened, strict=False)])
    owner = np.repeat(np.arange(len(streams)), per)
    end = np.append(start[1:], base[-1])
    end[np.cumsum(per) - 1] = base[1:]
    length = np.concatenate([o[3]["n"].astype(np.int64) for o in opened])
    if (data[start] != 0xFF).any() or (data[start + 1] != 0xF8).any() or (data[start + 3] != 0x02).any():
        raise Damaged("no frame of 8-bit mono samples at a seek point")
    lead = data[start + 4]
    coded = 1 + (lead >= 0xC0) * 1 + (lead >= 0xE0) * 1 + (lead >= 0xF0) * 1 + (lead >= 0xF8) * 1 + (lead >= 0xFC) * 1
    size_code, rate_code = data[start + 2] >> 4, data[start + 2] & 15
    head_end = start + 4 + coded + (size_code == 6) * 1 + (size_code == 7) * 2 + (rate_code == 12) * 1 + np.isin(rate_code, (13, 14)) * 2
    extra = start + 4 + coded
    stated = np.select([size_code == 1, size_code <= 5, size_code == 6, size_code == 7], [192, 576 << np.maximum(size_code.astype(np.int64) - 2, 0), data[extra].astype(np.int64) + 1, data[extra].astype(np.int64) * 256 + data[extra + 1] + 1], 256 << np.maximum(size_code.astype(np.int64) - 8, 0))
    if (stated != length).any() or (_crc(data, start, head_end, _CRC8, 8) != data[head_end]).any():
        raise Damaged("a frame header does not hold")
    if (_crc(data, start, end - 2, _CRC16, 16) != data[end - 2].astype(np.uint32) * 256 + data[end - 1]).any():
        raise Damaged("a frame's checksum does not hold")
    return _samples(streams, opened, data, 8 * (head_end + 1), length, owner)


def _samples(streams, opened, data: np.ndarray, at: np.ndarray, length: np.ndarray, owner: np.ndarray) -> list[bytes]:
    wide = data.astype(np.uint32)
    window = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]

    def take(a: np.ndarray, width: int) -> np.ndarray:
        """``width`` bits (25 at most) from each bit position, which moves on."""
        value = (window[a >> 3] << (a & 7).astype(np.uint32)) >> np.uint32(32 - width)
        a += width
        return value.astype(np.int64)

    signed = lambda v, width: v - ((v >> width - 1) << width)
    out_at = np.cumsum(length) - length + PAD
    out = np.zeros(int(length.sum()) + PAD, np.int32)
    at = at.copy()
    kind = take(at, 8)
    if (kind & 0x81).any():
        raise Damaged("wasted bits are not handled")
    kind >>= 1
    for i in np.flatnonzero(kind == 0).tolist():
        out[out_at[i] : out_at[i] + length[i]] = int(np.int8(data[at[i] >> 3]))
    for i in np.flatnonzero(kind == 1).tolist():
        out[out_at[i] : out_at[i] + length[i]] = data[at[i] >> 3 : (at[i] >> 3) + length[i]].view(np.int8)
    lanes = np.flatnonzero(kind > 1)
    order = np.where(kind[lanes] >= 32, kind[lanes] - 31, kind[lanes] - 8)
    if ((kind[lanes] < 32) & ((order < 0) | (order > 4))).any():
        raise Damaged("unknown subframe")
    deepest = int(order.max()) if len(order) else 0
    coefs, shift = np.zeros((deepest, len(lanes)), np.int32), np.zeros(len(lanes), np.int32)
    a, to = at[lanes], out_at[lanes]
    for j in range(deepest):
        some = np.flatnonzero(order > j)
        b = a[some]
        out[to[some] + j] = signed(take(b, 8), 8)
        a[some] = b
    for o in range(1, 5):
        some = np.flatnonzero((kind[lanes] < 32) & (order == o))
        for j, c in enumerate(FIXED[o] if len(some) else ()):
            coefs[j, some] = c
    some = np.flatnonzero(kind[lanes] >= 32)
    if len(some):
        b = a[some]
        precision, shift[some] = take(b, 4) + 1, take(b, 5)
        for j in range(deepest):
            for width in np.unique(precision).tolist():
                part = np.flatnonzero((order[some] > j) & (precision == width))
                c = b[part]
                coefs[j, some[part]] = signed(take(c, width), width)
                b[part] = c
        a[some] = b
    if take(a, 2).any():
        raise Damaged("five-bit Rice parameters are not handled")
    parts = take(a, 4)
    todo = length[lanes] - order
    rank = np.argsort(-todo, kind="stable")
    a, to, order, parts, todo, coefs, shift = a[rank], (to + order)[rank], order[rank], parts[rank], todo[rank], coefs[:, rank], shift[rank]
    per_part = length[lanes][rank] >> parts
    left, rice, raw = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.full(len(a), -1)
    fresh = per_part - order
    for step in range(int(todo[0]) if len(todo) else 0):
        n = int(np.searchsorted(-todo, -step, "left"))
        if n < len(a):
            a, to, left, rice, raw, per_part, coefs, shift, fresh, todo = a[:n], to[:n], left[:n], rice[:n], raw[:n], per_part[:n], coefs[:, :n], shift[:n], fresh[:n], todo[:n]
        if not left.all():
            new = np.flatnonzero(left == 0)
            b = a[new]
            rice[new] = take(b, 4)
            left[new] = per_part[new] if step else fresh[new]
            raw[new] = -1
            escaped = rice[new] == 15
            if escaped.any():
                c = b[escaped]
                raw[new[escaped]] = take(c, 5)
                b[escaped] = c
            a[new] = b
        word = window[a >> 3] << (a & 7).astype(np.uint32)
        zeros = 31 - (np.frexp(word.astype(np.float64))[1] - 1)
        far = np.flatnonzero(zeros > 24)
        for i in far.tolist():
            zeros[i] = 0
            while not data[int(a[i] + zeros[i]) >> 3] >> (7 - int(a[i] + zeros[i]) % 8) & 1 and raw[i] < 0:
                zeros[i] += 1
        b = a + zeros + 1
        low = (window[b >> 3] << (b & 7).astype(np.uint32)).astype(np.int64) >> (32 - rice)
        u = (zeros << rice) | low
        residual = (u >> 1) ^ -(u & 1)
        b += rice
        if (raw >= 0).any():
            for i in np.flatnonzero(raw >= 0).tolist():
                c = a[i : i + 1].copy()
                residual[i] = int(signed(take(c, int(raw[i])), int(raw[i]))[0]) if raw[i] else 0
                b[i] = c[0]
        a = b
        if deepest:
            guess = coefs[0] * out[to - 1]
            for j in range(1, deepest):
                guess += coefs[j] * out[to - 1 - j]
            residual = residual + (guess >> shift)
        out[to] = residual
        to = to + 1
        left -= 1
    if (out < -128).any() or (out > 127).any():
        raise Damaged("a sample is out of range")
    flat = out[PAD:].astype(np.int8)
    total = np.bincount(owner, length, len(streams)).astype(np.int64)
    bound = np.concatenate([[0], np.cumsum(total)]).tolist()
    found = []
    for o, a, b in zip(opened, bound, bound[1:], strict=False):
        own = flat[a:b]
        if hashlib.md5(own.tobytes(), usedforsecurity=False).digest() != o[2]:
            raise Damaged("the MD5 of the samples does not hold")
        found.append((own.view(np.uint8) ^ 0x80).tobytes())
    return found


class Bits:
    """Bits of a stream from a byte on, highest first."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, width: int) -> int:
        first, last = self.at >> 3, (self.at + width + 7) >> 3
        if last > len(self.data):
            raise Damaged("a frame is cut off")
        self.at += width
        return (int.from_bytes(self.data[first:last], "big") >> 8 * last - self.at) & ((1 << width) - 1)

    def signed(self, width: int) -> int:
        value = self.take(width)
        return value - (value >> width - 1 << width) if width else 0

    def zeros(self) -> int:
        """Zeros up to the next one, which is taken too."""
        n = 0
        while not self.take(1):
            n += 1
        return n


def _residuals(bits: Bits, size: int, order: int) -> list[int]:
    method, parts = bits.take(2), bits.take(4)
    if method > 1 or size >> parts << parts != size and parts or size >> parts < order:
        raise Damaged("unknown coding of residuals")
    width, out = 4 + method, []
    for part in range(1 << parts):
        rice, count = bits.take(width), (size >> parts) - (0 if part else order)
        if rice == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(count)]
        else:
            for _ in range(count):
                u = bits.zeros() << rice | bits.take(rice)
                out.append(u >> 1 ^ -(u & 1))
    return out


def _subframe(bits: Bits, size: int, width: int) -> list[int]:
    if bits.take(1):
        raise Damaged("a subframe begins with a one")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
    width -= wasted
    if kind == 0:
        out = [bits.signed(width)] * size
    elif kind == 1:
        out = [bits.signed(width) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(width) for _ in range(order)]
        coefs, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise Damaged("unknown precision or shift")
            coefs = [bits.signed(precision) for _ in range(order)]
        for residual in _residuals(bits, size, order):
            out.append(residual + (sum(c * out[-1 - j] for j, c in enumerate(coefs)) >> shift))
    else:
        raise Damaged("unknown subframe")
    return [x << wasted for x in out]


def _check(data: bytes, start: int, end: int, table: np.ndarray, bits: int) -> int:
    return int(_crc(np.frombuffer(data, np.uint8), np.array([start]), np.array([end]), table, bits)[0])


def _frame(data: bytes, start: int, stream_width: int) -> tuple[int, np.ndarray]:
    """Where the frame that begins at a byte ends, and its samples (n, channels)."""
    bits = Bits(data, start)
    if bits.take(15) != 0x7FFC:
        raise Damaged("no frame where one must begin")
    bits.take(1)
    size_code, rate_code, channels, width_code, zero = bits.take(4), bits.take(4), bits.take(4), bits.take(3), bits.take(1)
    lead = bits.take(8)
    ones = 8 - (lead ^ 0xFF).bit_length()
    if ones == 1 or ones > 7 or any(bits.take(8) >> 6 != 2 for _ in range(max(0, ones - 1))):
        raise Damaged("a frame's number is no number")
    if size_code == 0 or rate_code == 15 or channels > 10 or width_code == 3 or zero:
        raise Damaged("a frame header has a reserved value")
    size = {1: 192, 6: 0, 7: 0}.get(size_code, 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8 if size_code > 7 else 0)
    size = bits.take(8 * (size_code - 5)) + 1 if size_code in (6, 7) else size
    bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    head = bits.at >> 3
    if bits.take(8) != _check(data, start, head, _CRC8, 8):
        raise Damaged("a frame header does not hold")
    width = {0: stream_width, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[width_code]
    count = channels + 1 if channels < 8 else 2
    side = {8: 1, 9: 0, 10: 1}.get(channels)
    out = [_subframe(bits, size, width + (side == c)) for c in range(count)]
    bits.at = (bits.at + 7) // 8 * 8
    end = bits.at >> 3
    if bits.take(16) != _check(data, start, end, _CRC16, 16):
        raise Damaged("a frame's checksum does not hold")
    samples = np.array(out, np.int64).T
    if channels == 8:
        samples[:, 1] = samples[:, 0] - samples[:, 1]
    elif channels == 9:
        samples[:, 0] += samples[:, 1]
    elif channels == 10:
        middle = samples[:, 0] << 1 | samples[:, 1] & 1
        samples = np.stack([middle + samples[:, 1] >> 1, middle - samples[:, 1] >> 1], 1)
    return end + 2, samples


def _pcm(samples: np.ndarray, width: int, signed: bool = False) -> bytes:
    size = -(-width // 8)
    if size == 1 and not signed:
        samples = samples + 128
    return np.ascontiguousarray(samples, "<i8").reshape(-1, 1).view(np.uint8)[:, :size].tobytes()


def _walked(data: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    """PCM of any stream, and (sample offset, samples, byte offset) of each frame, found one after another."""
    if data[:4] != b"fLaC":
        raise Damaged("no FLAC marker")
    at, info = 4, None
    while True:
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        info = data[at + 4 : at + 4 + size] if kind == 0 else info
        last, at = data[at] & 0x80, at + 4 + size
        if last:
            break
    if info is None or len(info) < 34:
        raise Damaged("no STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    channels, width, total, md5 = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34]
    parts, frames, so_far = [], [], 0
    while at < len(data) if not total else so_far < total:
        end, samples = _frame(data, at, width)
        if samples.shape[1] != channels:
            raise Damaged("a frame has other channels")
        parts.append(samples)
        frames.append((so_far, len(samples), at))
        so_far, at = so_far + len(samples), end
    whole = np.concatenate(parts) if parts else np.zeros((0, channels), np.int64)
    if any(md5) and hashlib.md5(_pcm(whole, width, True), usedforsecurity=False).digest() != md5:
        raise Damaged("the MD5 of the samples does not hold")
    return _pcm(whole, width), frames


def _points(stream: bytes) -> list[tuple[int, int, int]]:
    at, _, _, points = _opened(stream)
    return [(int(p["sample"]), int(p["n"]), at + int(p["offset"])) for p in points]


def read(streams: list[bytes]) -> list[tuple[bytes | None, list[tuple[int, int, int]], str | None]]:
    """(PCM, (sample offset, samples, byte offset) of each frame, error) of each stream; of one that is damaged only the error."""
    try:
        return [(samples, _points(s), None) for s, samples in zip(streams, decode(streams), strict=True)]
    except (Damaged, IndexError, ValueError):
        pass  # a stream of another kind, or a damaged one: each on its own
    out = []
    for stream in streams:
        try:
            out.append((decode([stream])[0], _points(stream), None))
        except (Damaged, IndexError, ValueError):
            try:
                out.append((*_walked(stream), None))
            except (Damaged, IndexError, ValueError, OverflowError) as problem:
                out.append((None, [], str(problem) or "damaged"))
    return out


def payload(text: str | None) -> bytes:
    """UTF-8 bytes and zeros up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def features(samples: bytes) -> str:
    """Whole-number features of a payload's samples: count, sum, energy, peak and zero crossings."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"n={len(x)};sum={x.sum()};energy={(x * x).sum()};peak={np.abs(x).max()};crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))}"


def _flac(text: Column) -> Column:
    @F.arrow_udf("binary")
    def write(column: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([column.cast(pa.string())], names=["text"])
        return pa.array([s for piece in common.pieces([whole], most=STEP_BYTES) for s in encode([payload(t) for t in piece.column(0).to_pylist()])], pa.binary())

    return write(text)


def stored(documents: DataFrame) -> DataFrame:
    """(doc_id, flac): the FLAC stream of each row's text. Null counts as empty, which is 64 zero bytes."""

    return documents.select("doc_id", _flac(F.col("text")).alias("flac"))


_BLOCK = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("byte_offset", pa.int64()), ("pcm", pa.binary()), ("error", pa.string())])


def blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, byte_offset, pcm, error): a PCM block for each frame of each FLAC stream of ``media`` (doc_id, flac).

    ``byte_offset`` is where the frame begins in the stream, so that a reader can go to a sample
    directly. A damaged stream has one row with ``error`` and nothing else. Null streams have no row,
    repeated rows each have theirs; an empty table gives an empty result; other columns are left out,
    whatever their names. A stream is worked on whole, which takes about 100 times its samples' bytes.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "flac", STEP_BYTES):
            for doc, (samples, frames, error) in zip(piece.column("doc_id").to_pylist(), read(piece.column("flac").to_pylist()), strict=True):
                width = len(samples) // sum(f[1] for f in frames) if frames else 1
                found = [(doc, i, a, n, at, samples[a * width : (a + n) * width], None) for i, (a, n, at) in enumerate(frames)] if error is None else [(doc, None, None, None, None, None, error)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(_BLOCK)], schema=_BLOCK)

    return media.select("doc_id", "flac").where(F.col("flac").isNotNull()).mapInArrow(rows, "doc_id long, block long, sample_offset long, n_samples long, byte_offset long, pcm binary, error string")


_DIGEST = (
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ("n_blocks", pa.int64()), ("blocks_sha256", pa.string()), ("error", pa.string()),
)


def digest_of(text: str | None, stream: bytes, samples: bytes | None, frames: list[tuple[int, int, int]], error: str | None) -> tuple:
    """The values of ``_DIGEST``; ``blocks_sha256`` is of sample offset, size, byte offset and the PCM's own SHA-256 of each block."""
    media = (len(stream), hashlib.sha256(stream).hexdigest())
    n = len((text or "").encode())
    if error is not None:
        return (n, None, None, None, *media, None, None, None, error)
    table = ",".join(f"{a}:{size}:{at}:{hashlib.sha256(samples[a : a + size]).hexdigest()}" for a, size, at in frames)
    return (n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), *media, features(samples), len(frames), hashlib.sha256(table.encode()).hexdigest(), None)


def digests(documents: DataFrame) -> DataFrame:
    """Each row's text written as FLAC and read back: sizes, digests and features of what was read, and of its blocks.

    Null and empty texts are 64 zero bytes. A stream that could not be read back would have ``error``
    and null for what was read. Repeated rows each get a row. An empty table gives an empty result.
    Other columns are left out, whatever their names. A text is worked on whole, which takes about
    100 times its bytes.
    """

    @F.arrow_udf("struct<n_bytes: long, payload_bytes: long, payload_sha256: string, tail_crc32: long, media_bytes: long, media_sha256: string, feature: string, n_blocks: long, blocks_sha256: string, error: string>")
    def digest(texts: pa.Array, media: pa.Array) -> pa.Array:
        rows = []
        whole = pa.RecordBatch.from_arrays([texts.cast(pa.string()), media], names=["text", "flac"])
        for piece in common.pieces([whole], "flac", STEP_BYTES):
            streams = piece.column("flac").to_pylist()
            rows += [digest_of(t, stream, *found) for t, stream, found in zip(piece.column("text").to_pylist(), streams, read(streams), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_DIGEST)], [k for k, _ in _DIGEST])

    both = documents.select("doc_id", "text", _flac(F.col("text")).alias("_flac"))
    return both.select("doc_id", digest("text", "_flac").alias("_digest")).select("doc_id", "_digest.*")


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"))

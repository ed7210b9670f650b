"""Signals: as array columns for short ones, as numpy functions over Arrow batches for audio."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
# The window of five seconds that sounds are compared in, what counts as silent and as clipped in it, and the lags that are tried.
RATE, WINDOW = 16_000, 80_000
SILENT, CLIPPED = 1e-5, 1.0
MOST_LAG = 16


def doubles(signal: Column) -> Column:
    return F.transform(signal, lambda x: x.cast("double"))


def total(signal: Column) -> Column:
    return F.aggregate(signal, F.lit(0.0), lambda a, x: a + x)


def rounded(value: Column | str, digits: int) -> Column:
    """A double to ``digits`` places as SQL engines in C do it: the scaled number's halves go away from zero, and where nothing is left, zero has the sign of the number."""
    v, scale = F.col(value) if isinstance(value, str) else value, float(10**digits)
    return F.signum(v) * (F.round(F.abs(v) * scale, 0) / scale)


def energy(signal: Column) -> Column:
    return F.aggregate(signal, F.lit(0.0), lambda a, x: a + x * x)


def dbfs(amplitude: Column) -> Column:
    return 20 * F.log10(F.greatest(amplitude, F.lit(EPS)))


def peak(signal: Column) -> Column:
    return F.array_max(F.transform(signal, F.abs))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _by_length(*columns: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows whose lists have the same lengths, and their matrices."""
    lengths = np.stack([c.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for c in columns], 1)
    for sizes in np.unique(lengths, axis=0) if len(lengths) else []:
        rows = np.flatnonzero((lengths == sizes).all(1))
        if (sizes >= 0).all():
            yield rows, [_matrix(c.take(pa.array(rows))) for c in columns]


def lagged_correlations(left: Column, right: Column, most: int) -> Column:
    """Pearson correlations of ``left`` with ``right`` 0, 1, ... samples later and earlier, over their overlap, from ``-most`` to ``most``.

    0 where either is constant or nothing overlaps; null signals and signals of unlike lengths give null.
    """

    @F.arrow_udf("array<double>")
    def correlate(a: pa.Array, b: pa.Array) -> pa.Array:
        out: list = [None] * len(a)
        for rows, (x, y) in _by_length(a, b):
            n = x.shape[1]
            if n != y.shape[1]:
                continue
            found = np.zeros((len(rows), 2 * most + 1))
            for i, k in enumerate(range(-most, most + 1)):
                if abs(k) < n:
                    u, v = x[:, max(0, -k) : n - max(0, k)], y[:, max(0, k) : n - max(0, -k)]
                    u, v = u - u.mean(1, keepdims=True), v - v.mean(1, keepdims=True)
                    norm = np.sqrt((u * u).sum(1) * (v * v).sum(1))
                    found[:, i] = np.where(norm > 0, (u * v).sum(1) / (norm + EPS), 0.0)
            for row, values in zip(rows.tolist(), found.tolist(), strict=True):
                out[row] = values
        return pa.array(out, pa.list_(pa.float64()))

    return correlate(left, right)


def convolved(left: Column, right: Column) -> Column:
    """The full convolution of two signals, by the transform of a batch of rows at once."""

    @F.arrow_udf("array<double>")
    def convolve_rows(a: pa.Array, b: pa.Array) -> pa.Array:
        out: list = [None] * len(a)
        for rows, (x, y) in _by_length(a, b):
            n = x.shape[1] + y.shape[1] - 1
            if min(x.shape[1], y.shape[1]) == 0:
                found = np.zeros((len(rows), 0))
            else:
                size = 1 << max(0, n - 1).bit_length()
                found = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[:, :n]
            for row, values in zip(rows.tolist(), found.tolist(), strict=True):
                out[row] = values
        return pa.array(out, pa.list_(pa.float64()))

    return convolve_rows(left, right)


def window_fault(rate: Column, channels: Column, dtype: Column, finite: Column, n: Column, wanted: int = RATE, least: int = WINDOW) -> Column:
    """Why a sound has no window to compare: its rate, channels, type, values or length, the first that is wrong; null if it has one."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(no(rate == wanted), "rate").when(no(channels == 2), "channels").when(no(dtype == "float32"), "type").when(no(finite), "not finite").when(no(n >= least), "short")


_LEVELS = ["rms_left_dbfs", "rms_right_dbfs", "rms_mean_dbfs", "ild_db", "mean_square_left", "mean_square_right", "peak_left", "peak_right", "peak_max", "silence_fraction", "clipping_fraction", "energy_left", "energy_right", "energy_total", "duration_sec"]


def window_metrics(left: Column, right: Column, rate: int = RATE, window: int = WINDOW, silent: float = SILENT, clipped: float = CLIPPED) -> Column:
    """A struct of levels, peaks and shares of the first ``window`` samples, and energies and duration of the whole sound; null where it is shorter or an ear is missing."""

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in _LEVELS) + ">")
    def measure(a: pa.Array, b: pa.Array) -> pa.Array:
        out: list = [None] * len(a)
        for rows, (x, y) in _by_length(a, b):
            n = x.shape[1]
            if n != y.shape[1] or n < window:
                continue
            u, v = x[:, :window], y[:, :window]
            pu, pv = (u * u).mean(1), (v * v).mean(1)
            level = lambda power: 20 * np.log10(np.maximum(np.sqrt(power), EPS))
            tu, tv = np.abs(u).max(1), np.abs(v).max(1)
            quiet, loud = (np.maximum(np.abs(u), np.abs(v)) < silent).mean(1), ((np.abs(u) >= clipped).mean(1) + (np.abs(v) >= clipped).mean(1)) / 2
            ex, ey = (x * x).sum(1), (y * y).sum(1)
            found = [level(pu), level(pv), level((pu + pv) / 2), 10 * np.log10((pu + EPS) / (pv + EPS)), pu, pv, tu, tv, np.maximum(tu, tv), quiet, loud, ex, ey, ex + ey, np.full(len(rows), n / rate)]
            for row, values in zip(rows.tolist(), zip(*(f.tolist() for f in found), strict=True), strict=True):
                out[row] = dict(zip(_LEVELS, values, strict=True))
        return pa.array(out, pa.struct([(n, pa.float64()) for n in _LEVELS]))

    return measure(left, right)


def _full(dry: np.ndarray, rir: np.ndarray) -> np.ndarray:
    n = len(dry) + len(rir) - 1
    size = 1 << max(0, n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(dry, size)[:, None] * np.fft.rfft(rir, size, axis=0), size, axis=0)[:n]


def convolve(dry: np.ndarray, rir: np.ndarray) -> np.ndarray:
    """Full convolution of each channel, as float32: ``dry`` (n,), ``rir`` (m, channels)."""
    return _full(dry, rir).astype(np.float32)


def heard(source: np.ndarray, rir: np.ndarray, begin: int, count: int, wrap: bool = False) -> np.ndarray:
    """(count, channels): samples from ``begin`` on of a source through a response (m, channels), with what sounded before.

    Past the source's end it is silent, or begins again if ``wrap``; an empty response is silence.
    """
    if not len(rir):
        return np.zeros((count, rir.shape[1]))
    early = max(0, begin - len(rir) + 1)
    segment = source.take(np.arange(early, begin + count), mode="wrap") if wrap else source[early : begin + count]
    if not len(segment):
        return np.zeros((count, rir.shape[1]))
    found = _full(segment, rir)[begin - early : begin - early + count]
    return np.pad(found, [(0, count - len(found)), (0, 0)])


def crossfade(before: np.ndarray, now: np.ndarray, rate: int, seconds: float = 0.05) -> np.ndarray:
    """``now`` (n, channels), its first ``seconds`` blended linearly out of ``before``."""
    n = int(seconds * rate)
    if not n:
        return now
    share = np.arange(n + 1)[:, None] / n
    return np.concatenate([before[: n + 1] * share[::-1] + now[: n + 1] * share, now[n + 1 :]])


def resample(x: np.ndarray, rate: int, to: int, expected: int | None = None) -> np.ndarray:
    """Polyphase resampling with a Kaiser window of shape 5, zeros beyond the ends, as float32; ValueError if not ``expected`` samples come out."""
    out = resampled(x, rate, to).astype(np.float32)
    if expected is not None and len(out) != expected:
        raise ValueError(f"{len(out)} samples, not {expected}")
    return out


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """``resample`` in double precision."""
    g = gcd(rate, to)
    up, down = to // g, rate // g
    if up == down:
        return x.astype(np.float64)
    most = max(up, down)
    half = 10 * most
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / most) / most * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    n = -(-len(x) * up // down)
    at = np.arange(n) * down
    phase, first = (at + half) % up, (at + half) // up
    width = (2 * half) // up + 1
    padded = np.concatenate([np.zeros(width), x, np.zeros(width + 1)])
    out = np.zeros(n)
    for j in range(width):
        tap = phase + j * up
        use = tap <= 2 * half
        out[use] += taps[tap[use]] * padded[np.clip(first[use] - j + width, 0, len(padded) - 1)]
    return out


def spectrogram(channels: np.ndarray, n_fft: int = 512, hop: int = 160, window: int = 400) -> np.ndarray:
    """log1p of the 4 x 4 block means of |STFT| of each channel, Hann window, centred, zeros beyond the ends."""
    hann = np.zeros(n_fft)
    begin = (n_fft - window) // 2
    hann[begin : begin + window] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    out = []
    for x in channels:
        padded = np.pad(x, n_fft // 2)
        frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
        size = np.abs(np.fft.rfft(frames * hann, axis=1)).T
        size = np.pad(size, [(0, -size.shape[0] % 4), (0, -size.shape[1] % 4)])
        out.append(np.log1p(size.reshape(size.shape[0] // 4, 4, -1, 4).mean((1, 3))))
    return np.stack(out, -1)


def audio_window(source: np.ndarray, rir: np.ndarray, index: int, rate: int) -> np.ndarray:
    """The second ``index`` of a source heard through a room response (m, 2), reverberation of earlier sound included."""
    return heard(source, rir, index * rate, rate).astype(np.float32).T


def golden_probe(seed: int = 20260824, n: int = 80_000, scale: float = 0.05) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal(n).astype(np.float32) * np.float32(scale)

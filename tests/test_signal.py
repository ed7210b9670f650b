import hashlib
import struct

import numpy as np
import pytest

from auralake.functions import signal


def test_probe_is_the_registered_one():
    x = signal.golden_probe()
    assert abs(float(np.abs(x).max()) - 0.22226334) < 1e-8
    assert abs(float(np.sqrt((x.astype(float) ** 2).mean())) - 0.05012242) < 1e-8
    head = b"RIFF" + struct.pack("<I", 50 + 4 * len(x)) + b"WAVEfmt " + struct.pack("<IHHIIHHH", 18, 3, 1, 16000, 64000, 4, 32, 0) + b"fact" + struct.pack("<II", 4, len(x)) + b"data" + struct.pack("<I", 4 * len(x))
    assert hashlib.sha256(head + x.tobytes()).hexdigest() == "df63d31dcbe1a7b0868163b81206f97f5d9928685a70e50e568d43bd90b8c54d"


def test_convolution_of_a_short_signal():
    out = signal.convolve(np.array([1.0, 2, 3]), np.array([[1.0, 10], [2, 20]]))
    assert out.dtype == np.float32
    np.testing.assert_allclose(out, [[1, 10], [4, 40], [7, 70], [6, 60]], atol=1e-4)


@pytest.mark.parametrize("rate", [24000, 44100, 48000])
def test_resampling_keeps_the_duration_and_a_tone(rate):
    t = np.arange(5 * rate) / rate
    out = signal.resample(np.sin(2 * np.pi * 440 * t), rate, 16000)
    assert len(out) == 80000
    want = np.sin(2 * np.pi * 440 * np.arange(80000) / 16000)
    assert np.abs(out[2000:-2000] - want[2000:-2000]).max() < 0.02


def test_spectrogram_shape():
    assert signal.spectrogram(np.zeros((2, 16000))).shape == (65, 26, 2)
    assert signal.spectrogram(np.zeros((2, 44100))).shape == (65, 69, 2)


def test_window_of_a_long_source_is_the_whole_convolution():
    rng = np.random.default_rng(0)
    source, room = rng.standard_normal(300), rng.standard_normal((50, 2))
    np.testing.assert_allclose(signal.audio_window(source, room, 1, 100), signal.convolve(source, room)[100:200].T, atol=1e-3)


def test_sound_by_steps():
    """Against plain sums: before the response is over, in the middle, past the end, and where the source begins again."""
    rng = np.random.default_rng(3)
    source, room = rng.normal(size=50), rng.normal(size=(9, 2))
    for wrap in (False, True):
        for begin in (0, 4, 20, 45, 49):
            found = signal.heard(source, room, begin, 10, wrap)
            for i in range(10):
                past = [(k, begin + i - k) for k in range(9) if begin + i - k >= 0 and (wrap or begin + i - k < 50)]
                assert np.allclose(found[i], sum((room[k] * source[t % 50] for k, t in past), np.zeros(2)))
    assert not signal.heard(source, np.zeros((0, 2)), 3, 10).any() and not signal.heard(source, room, 70, 10).any()


def test_crossfade():
    mixed = signal.crossfade(np.ones((100, 1)), np.zeros((100, 1)), 100)
    assert np.allclose(mixed[:6, 0], [1, 0.8, 0.6, 0.4, 0.2, 0]) and not mixed[6:].any()
    assert (signal.crossfade(np.ones((4, 1)), np.zeros((4, 1)), 10) == 0).all()


def test_resampling_says_how_many_samples_it_wants():
    assert len(signal.resample(np.ones(48), 48000, 16000, 16)) == 16
    with pytest.raises(ValueError, match="17"):
        signal.resample(np.ones(48), 48000, 16000, 17)


def _direct(x, frame, k, n_fft=512, hop=160, window=400):
    """|DFT| of one frame at one frequency, by its sum."""
    begin = frame * hop - n_fft // 2 + (n_fft - window) // 2
    total = 0
    for i in range(window):
        t = begin + i
        if 0 <= t < len(x):
            total += x[t] * (0.5 - 0.5 * np.cos(2 * np.pi * i / window)) * np.exp(-2j * np.pi * k * (i + (n_fft - window) // 2) / n_fft)
    return abs(total)


@pytest.mark.parametrize("x", [np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000), np.eye(1, 16000, 5000)[0], np.random.default_rng(2).normal(size=16000)], ids=["tone", "impulse", "noise"])
def test_spectrogram_against_direct_sums(x):
    found = signal.spectrogram(np.stack([x, np.zeros(16000)]))
    assert found.shape == (65, 26, 2) and not found[:, :, 1].any()
    frames = 1 + 16000 // 160
    for band, block in ((0, 0), (8, 7), (8, 8), (31, 12), (64, 25)):
        cells = [_direct(x, f, k) if f < frames and k <= 256 else 0.0 for k in range(4 * band, 4 * band + 4) for f in range(4 * block, 4 * block + 4)]
        assert found[band, block, 0] == pytest.approx(np.log1p(np.mean(cells)), abs=1e-9)


def test_window_metrics(spark):
    x = np.zeros((80003, 2), np.float32)
    x[:100], x[100, 0] = (0.5, 0.25), 1.0
    ones = np.ones((80003, 2), np.float32)
    rows = [(0, x[:80000, 0].tolist(), x[:80000, 1].tolist()), (1, ones[:, 0].tolist(), ones[:, 1].tolist()), (2, ones[:79999, 0].tolist(), ones[:79999, 1].tolist()), (3, None, [1.0])]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "i int, l array<float>, r array<float>")
    found = {r.i: r.m for r in frame.select("i", signal.window_metrics(F.col("l"), F.col("r")).alias("m")).collect()}
    m = found[0]
    assert m.rms_left_dbfs == pytest.approx(20 * np.log10(np.sqrt(0.26 / 800))) and m.ild_db > 0 and (m.peak_left, m.peak_right, m.peak_max) == (1.0, 0.25, 1.0)
    assert m.silence_fraction == (80000 - 101) / 80000 and m.clipping_fraction == 1 / 160000
    assert (found[1].energy_total, found[1].duration_sec, found[2], found[3]) == (160006, 80003 / 16000, None, None)


def test_sounds_without_a_window(spark, tmp_path):
    from auralake.sources import audio, dataset

    x = np.random.default_rng(1).normal(scale=0.1, size=80000).astype(np.float32)
    both = np.stack([x, np.roll(x, 5)], 1)
    odd = both.copy()
    odd[3, 1] = np.inf
    for name, data, rate in (("fine", both, 16000), ("rate", both, 8000), ("mono", x, 16000), ("odd", odd, 16000), ("short", both[:79999], 16000)):
        (tmp_path / f"{name}.wav").write_bytes(audio.write_wav(data, rate))
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    rows = {r.path: r for r in dataset.waveform_metrics(spark, str(tmp_path)).collect()}
    assert {k: r.fault for k, r in rows.items()} == {"fine.wav": None, "rate.wav": "rate", "mono.wav": "channels", "odd.wav": "not finite", "short.wav": "short", "broken.wav": "unreadable"}
    assert rows["fine.wav"].interaural_lag_samples == 5 and rows["fine.wav"].interaural_correlation > 0.99 and rows["odd.wav"].rms_mean_dbfs is None

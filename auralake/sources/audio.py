"""WAV and NPZ payloads: decoded on executors from ``binaryFile`` rows, written back as file images."""

from __future__ import annotations

import hashlib
import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNAL = "struct<left: array<float>, right: array<float>, sr: int, n: int, channels: int, error: string>"


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """A float32 WAV image of samples (n,) or (n, channels)."""
    channels = 1 if samples.ndim == 1 else samples.shape[1]
    data = np.ascontiguousarray(samples, "<f4").tobytes()
    form = struct.pack("<HHIIHHH", 3, channels, rate, 4 * channels * rate, 4 * channels, 32, 0)
    body = b"WAVEfmt " + struct.pack("<I", 18) + form + b"fact" + struct.pack("<II", 4, len(samples)) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (n, channels) as float32 in [-1, 1] and the rate; float32 and 8, 16 and 32-bit integer samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
        elif kind == b"data":
            if form is None:
                raise ValueError("data before format")
            tag, channels, rate, _, _, bits = form
            if (tag, bits) == (3, 32):
                x = np.frombuffer(body, "<f4")
            elif (tag, bits) in ((1, 16), (1, 32)):
                x = np.frombuffer(body, f"<i{bits // 8}") / float(1 << bits - 1)
            elif (tag, bits) == (1, 8):
                x = (np.frombuffer(body, np.uint8) - 128.0) / 128
            else:
                raise ValueError(f"samples of format {tag} with {bits} bits")
            return x.astype(np.float32).reshape(-1, channels), rate
        at += 8 + size + size % 2
    raise ValueError("no data")


def read_npz(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of an NPZ image; pickled objects are refused."""
    with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
        return {k: arrays[k] for k in arrays.files}


def canonical(native: np.ndarray) -> np.ndarray:
    """A finite (2, n) response as (n, 2) float32."""
    if native.ndim != 2 or native.shape[0] != 2 or not np.isfinite(native).all():
        raise ValueError("expected a finite array of two channels")
    return np.ascontiguousarray(native.T, np.float32)


def dry_hash(signal: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(signal, "<f4").tobytes()).hexdigest()


def decoded(content: Column, kind: str) -> Column:
    """The signal of a WAV or NPZ (members ``rir`` and ``sample_rate_hz``) image; ``error`` says what is wrong with it."""

    @F.arrow_udf(SIGNAL)
    def decode(column: pa.Array) -> pa.Array:
        rows = []
        for item in column:
            try:
                if kind == "wav":
                    x, rate = read_wav(item.as_py())
                else:
                    arrays = read_npz(item.as_py())
                    x, rate = arrays["rir"], int(arrays["sample_rate_hz"])
                rows.append({"left": x[:, 0], "right": x[:, -1], "sr": rate, "n": len(x), "channels": x.shape[1], "error": None})
            except (ValueError, KeyError, TypeError, OSError) as problem:
                rows.append({"left": None, "right": None, "sr": None, "n": None, "channels": None, "error": str(problem)[:200]})
        fields = [("left", pa.list_(pa.float32())), ("right", pa.list_(pa.float32())), ("sr", pa.int32()), ("n", pa.int32()), ("channels", pa.int32()), ("error", pa.string())]
        return pa.StructArray.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], [n for n, _ in fields])

    return decode(content)


def read_signals(spark: SparkSession, path: str, kind: str = "wav") -> DataFrame:
    """(path, length, sha256, left, right, sr, n, channels, error) of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), decoded(F.col("content"), kind).alias("_s")).select("path", "length", "sha256", "_s.*")


def audited(registry: DataFrame, files: DataFrame, least_seconds: float = 5.0) -> DataFrame:
    """(audio_id, problem) for each rule that a registry row (audio_id, path, sample_rate_hz, sha256) breaks against ``files``, those of ``read_signals`` or of the format ``wav``.

    ``channels`` and ``duration_sec`` are checked where the registry has them. Rows find their file by its
    name and then by the whole of their path.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    odd = lambda ear: F.exists(ear, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    joined = registry.alias("r").join(files.alias("f"), (name("f.path") == name("r.path")) & F.col("f.path").endswith(F.col("r.path")), "left")
    rules = {
        "missing": F.col("f.path").isNull(),
        "unreadable": F.col("f.error").isNotNull(),
        "hash": F.col("f.sha256") != F.col("r.sha256"),
        "rate": F.col("f.sr") != F.col("r.sample_rate_hz"),
        "short": F.col("f.n") < least_seconds * F.col("f.sr"),
        "not finite": ~F.col("f.finite") if "finite" in files.columns else odd("f.left") | odd("f.right"),
    }
    if "channels" in registry.columns:
        rules["channels"] = F.col("f.channels") != F.col("r.channels")
    if "duration_sec" in registry.columns:
        rules["duration"] = F.abs(F.col("f.n") / F.col("f.sr") - F.col("r.duration_sec")) > 1e-6
    broken = joined.select(F.col("r.audio_id").alias("audio_id"), F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))).alias("problem"))
    twice = registry.groupBy("audio_id").count().where("count > 1").select("audio_id", F.lit("repeated id").alias("problem"))
    return broken.unionByName(twice)

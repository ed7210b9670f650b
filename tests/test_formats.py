"""WAV, NPZ and plain files as data sources, and numbered lines."""

import hashlib
import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.sources import audio, formats, tables


@pytest.fixture(scope="module")
def formatted(spark):
    formats.register(spark)
    return spark


def _files(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names if not n.startswith("."))


def _sounds(folder):
    rng = np.random.default_rng(1)
    made = {}
    for i in range(7):
        x = rng.normal(size=(100 * (i + 1), 1 + i % 3)).astype(np.float32)
        path = folder / f"d{i % 2}" / f"s{i}.wav"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(audio.write_wav(x, 8000 + i))
        made[str(path)] = x
    return made


def test_sounds_are_read_with_statistics_of_all_channels(formatted, tmp_path):
    made = _sounds(tmp_path)
    x = np.zeros((50, 2), np.float32)
    x[3, 1] = np.nan
    (tmp_path / "nan.wav").write_bytes(audio.write_wav(x, 16000))
    (tmp_path / "cut.wav").write_bytes(audio.write_wav(x, 16000)[:100])
    (tmp_path / "_hidden.wav").write_bytes(b"x")
    rows = {r.path: r for r in formatted.read.format("wav").load(str(tmp_path)).collect()}
    assert len(rows) == 9
    for path, own in made.items():
        r = rows[path]
        assert (r.n, r.channels, r.dtype, r.finite, r.error) == (len(own), own.shape[1], "float32", True, None)
        assert r.peak == np.abs(own).max() and r.rms == pytest.approx(np.sqrt(np.mean(own.astype(float) ** 2)))
        assert r.left == own[:, 0].tolist() and r.right == own[:, -1].tolist()
        assert r.sha256 == hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert rows[str(tmp_path / "nan.wav")].finite is False
    assert "are there" in rows[str(tmp_path / "cut.wav")].error
    with pytest.raises(Exception, match="cut.wav"):
        formatted.read.format("wav").option("mode", "failfast").load(str(tmp_path)).collect()


def test_heads_alone_are_read_without_samples(formatted, tmp_path, monkeypatch):
    """A file whose samples are a hole of 1 GB takes no time, and many heads go to one task."""
    head = audio.write_wav(np.zeros((0, 2), np.float32), 16000)
    size = 1 << 30
    with open(tmp_path / "large.wav", "wb") as out:
        out.write(head[:-4] + size.to_bytes(4, "little"))
        out.truncate(len(head) + size)
    rows = formatted.read.format("wav").schema("path string, sr int, n long").load(str(tmp_path)).collect()
    assert [(r.sr, r.n) for r in rows] == [(16000, size // 8)]
    files = [(f"f{i}", 10_000_000) for i in range(100)]
    assert len(formats.planned(files, formats.PART_BYTES, formats.FILE_BYTES, True)) == 1
    dealt = formats.planned(files, formats.PART_BYTES, formats.FILE_BYTES, False)
    assert len(dealt) == 8 and sorted(f for p in dealt for f in p) == sorted(files)


def test_sounds_written_are_read_again(formatted, tmp_path):
    made = _sounds(tmp_path)
    out = str(tmp_path / "out")
    schema = "path string, sr int, samples array<array<float>>, samples_sha256 string"
    before = formatted.read.format("wav").schema(schema).load(str(tmp_path))
    named = before.withColumn("path", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1))
    named.write.format("wav").mode("append").save(out)
    after = {r.path[len(out) + 1 :]: r for r in formatted.read.format("wav").schema(schema).load(out).collect()}
    assert len(after) == len(made) and not [f for f in _files(out) if "temporary" in f]
    for path, x in made.items():
        r = after["/".join(path.split("/")[-2:])]
        assert np.array_equal(np.array(r.samples, np.float32), x.T)
    with pytest.raises(Exception, match="already"):
        named.write.format("wav").mode("append").save(out)
    assert len(_files(out)) == len(made)
    named.limit(2).write.format("wav").mode("overwrite").save(out)
    assert len(_files(out)) == 2


@pytest.mark.parametrize("bad", ["boom", "../out.txt", "/etc/x", "", "a/../../b"])
def test_a_failed_task_leaves_no_file(formatted, tmp_path, bad):
    rows = formatted.range(20).repartition(4).select(F.format_string("f%d.txt", "id").alias("path"), F.lit("text").alias("content"))
    if bad == "boom":
        rows = rows.withColumn("content", F.when(F.col("path") == "f7.txt", F.raise_error(F.lit("boom"))).otherwise(F.col("content")))
    else:
        rows = rows.withColumn("path", F.when(F.col("path") == "f7.txt", F.lit(bad)).otherwise(F.col("path")))
    with pytest.raises(Exception, match="boom|path below"):
        rows.write.format("files").mode("append").save(str(tmp_path / "out"))
    assert _files(tmp_path / "out") == [] and os.listdir(tmp_path / "out") == []


def test_a_name_that_is_written_twice_is_refused(formatted, tmp_path):
    rows = formatted.range(20).repartition(4).select(F.concat(F.lit("f"), F.col("id") % 19).alias("path"), F.lit("text").alias("content"))
    with pytest.raises(Exception, match="more than once"):
        rows.write.format("files").mode("append").save(str(tmp_path / "out"))
    assert _files(tmp_path / "out") == []
    rows.where("id < 19").write.format("files").mode("append").save(str(tmp_path / "out"))
    found = formatted.read.format("files").load(str(tmp_path / "out")).collect()
    assert len(found) == 19 and {bytes(r.content) for r in found} == {b"text"}


def test_arrays_of_archives(formatted, tmp_path):
    arrays = {"rir": np.arange(12, dtype=np.float32).reshape(6, 2), "sample_rate_hz": np.int64(16000), "names": np.array(["a", "bc"])}
    for i in range(3):
        np.savez(tmp_path / f"a{i}.npz", **arrays)
    np.savez(tmp_path / "objects.npz", x=np.array([{}], object))
    (tmp_path / "bad.npz").write_bytes(b"PK nothing")
    rows = formatted.read.format("npz").load(str(tmp_path))
    assert {r.path.rpartition("/")[2] for r in rows.where("error is not null").collect()} == {"objects.npz", "bad.npz"}
    heads = formatted.read.format("npz").schema("path string, member string, dtype string, shape array<long>").load(str(tmp_path / "a0.npz"))
    assert {(r.member, r.dtype, tuple(r["shape"])) for r in heads.collect()} == {("rir", "float32", (6, 2)), ("sample_rate_hz", "int64", ()), ("names", "str64", (2,))}
    fine = rows.where("error is null and member <> 'names'")
    one = fine.where("member = 'rir'").first()
    assert (one.finite, one.peak, np.frombuffer(one.data, "<f4").tolist()) == (True, 11.0, list(range(12)))
    named = fine.withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1)).repartition("path").sortWithinPartitions("path")
    named.write.format("npz").mode("append").save(str(tmp_path / "out"))
    for i in range(3):
        with np.load(io.BytesIO((tmp_path / "out" / f"a{i}.npz").read_bytes())) as back:
            assert np.array_equal(back["rir"], arrays["rir"]) and back["sample_rate_hz"] == 16000


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = {f"f{k}.jsonl": [f'{{"v": {i}}}' if i % 7 else "" for i in range(n)] for k, n in enumerate((3000, 1, 0, 500))}
    for name, own in lines.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in own))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = tables.numbered_lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 10
        assert sorted((r.path.rpartition("/")[2], r.line, r.value) for r in found.collect()) == sorted((n, i + 1, x) for n, own in lines.items() for i, x in enumerate(own))
        rows = tables.read_jsonl(spark, str(tmp_path), "v long")
        assert sorted(r.v for r in rows.collect()) == sorted(i for own in lines.values() for i in range(len(own)) if i % 7)
        own = lines["f0.jsonl"]
        for at, text in ((2345, '{"v": 1'), (11, "[1]"), (2999, '{"v": "x"}')):
            (tmp_path / "f0.jsonl").write_text("".join(x + "\n" for x in [*own[:at], text, *own[at + 1 :]]))
            with pytest.raises(Exception, match=rf"f0.jsonl:{at + 1}:"):
                tables.read_jsonl(spark, str(tmp_path), "v long").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

import csv
import datetime
import gzip
import hashlib
import io
import json

import numpy as np
import pytest

from auralake.functions import signal
from auralake.plans import records
from auralake.sources import audio, commits, registries, tables


def test_wav_images_round_trip():
    x = np.stack([np.linspace(-1, 1, 50), np.linspace(1, -1, 50)], 1).astype(np.float32)
    back, rate = audio.read_wav(audio.write_wav(x, 16000))
    assert rate == 16000 and (back == x).all()
    with pytest.raises(ValueError, match="WAV"):
        audio.read_wav(b"nope" * 10)


def test_signals_are_read_and_audited(spark, tmp_path):
    probe = signal.golden_probe()
    (tmp_path / "probe.wav").write_bytes(audio.write_wav(probe, 16000))
    (tmp_path / "broken.wav").write_bytes(b"RIFFxxxx")
    rows = {r.path.rpartition("/")[2]: r for r in audio.read_signals(spark, str(tmp_path)).collect()}
    assert rows["probe.wav"].sha256 == "df63d31dcbe1a7b0868163b81206f97f5d9928685a70e50e568d43bd90b8c54d"
    assert (rows["probe.wav"].n, rows["probe.wav"].sr) == (80000, 16000) and rows["broken.wav"].error
    registry = spark.createDataFrame([("golden", "probe.wav", 16000, rows["probe.wav"].sha256), ("bad", "broken.wav", 16000, "0"), ("gone", "none.wav", 16000, "0")], "audio_id string, path string, sample_rate_hz int, sha256 string")
    found = {tuple(r) for r in audio.audited(registry, audio.read_signals(spark, str(tmp_path))).collect()}
    assert found == {("bad", "unreadable"), ("bad", "hash"), ("gone", "missing")}


def test_npz_signals(spark, tmp_path):
    image = io.BytesIO()
    np.savez(image, rir=np.ones((7, 2), np.float32), sample_rate_hz=16000, num_samples=7)
    (tmp_path / "a.npz").write_bytes(image.getvalue())
    row = audio.read_signals(spark, str(tmp_path), "npz").first()
    assert (row.n, row.sr, row.error, row.left) == (7, 16000, None, [1.0] * 7)


def test_native_responses():
    assert audio.canonical(np.array([[1.0, 2, 3], [10, 20, 30]]))[:, 0].tolist() == [1, 2, 3]
    with pytest.raises(ValueError, match="finite"):
        audio.canonical(np.array([[np.nan], [1]]))
    assert audio.dry_hash(np.zeros(2)) == audio.dry_hash(np.zeros(2, np.float32))


def test_outputs_are_guarded(spark, tmp_path):
    out = commits.Output(spark, str(tmp_path), "set_a")
    rows = spark.createDataFrame([("b", 1), ("a", 2)], "id string, v int")
    with pytest.raises(ValueError, match="repeats"):
        out.write("episodes", rows.unionAll(rows), ["id"])
    out.write("episodes", rows, ["id"])
    assert [r.id for r in spark.read.json(f"{out.folder}/episodes").orderBy("id").collect()] == ["a", "b"]
    assert {r.kind for r in out.bytes_by_kind().collect()} == {"json"}
    with pytest.raises(ValueError, match="passed"):
        out.finish({"status": "FAIL"})
    out.finish({"status": "PASS"})
    with pytest.raises(PermissionError):
        out.write("episodes", rows, ["id"])


def test_logs_are_added_to(spark, tmp_path):
    out = commits.Output(spark, str(tmp_path), "set_b")
    for step in range(3):
        out.append("events", spark.createDataFrame([(step, "done")], "step int, what string"))
        out.append("scalars", spark.createDataFrame([(step, step / 2), (step, None)], "step int, loss double"), "csv")
    assert sorted(r.step for r in spark.read.json(f"{out.folder}/events").collect()) == [0, 1, 2]
    scalars = spark.read.option("header", True).schema("step int, loss double").csv(f"{out.folder}/scalars")
    assert sorted((r.step, r.loss) for r in scalars.where("loss is not null").collect()) == [(0, 0.0), (1, 0.5), (2, 1.0)] and scalars.count() == 6
    out.finish({"status": "PASS"})
    with pytest.raises(PermissionError):
        out.append("events", spark.createDataFrame([(9, "late")], "step int, what string"))


@pytest.mark.parametrize("name", ["a\\b", "tab\tname", "trailing.", "..", "set/a", "C:", "\0", ""])
def test_unsafe_names(name):
    with pytest.raises(ValueError, match="component"):
        commits.safe_component(name)


def test_configuration_and_evidence():
    base = {"audio": {"sample_rate_hz": 16000, "segment_seconds": 5}, "dataset_id": "a", "seed": 1}
    assert commits.violated(base) == []
    assert commits.violated(commits.merged(base, {"audio": {"sample_rate_hz": 8000}, "seed": True})) == ["audio.sample_rate_hz", "seed"]
    assert commits.evidence_status(None) == "UNKNOWN"
    assert commits.evidence_status({"spot_checks": [{"passed": True}] * 3}) == "PASS"
    with pytest.raises(ValueError, match="spot"):
        commits.evidence_status({"spot_checks": []})


def test_reports(spark, tmp_path):
    out = commits.Output(spark, str(tmp_path), "set_b")
    rows = spark.createDataFrame([(3, 0.5)], "episodes long, rate double")
    found = out.report("geometry", rows)
    assert (found["episodes"], found["rate"]) == (3, 0.5)
    written = datetime.datetime.fromisoformat(found["generated_at"])
    assert abs((datetime.datetime.now(datetime.UTC) - written).total_seconds()) < 60
    out.text("summary.md", "| a |\n")
    assert (tmp_path / "set_b" / "summary.md").read_text() == "| a |\n" and (tmp_path / "set_b" / "geometry.json").exists()
    with pytest.raises(ValueError, match="one row"):
        out.report("geometry", rows.unionAll(rows))
    out.finish({"status": "PASS"})
    with pytest.raises(PermissionError):
        out.report("geometry", rows)


def test_scene_registry(spark, tmp_path):
    pytest.importorskip("yaml")
    for name in ("a.glb", "a.navmesh", "a.json"):
        (tmp_path / name).touch()
    text = "scenes:\n  room:\n    dataset: d\n    scene_asset: a.glb\n    navmesh: a.navmesh\n    semantic_info: a.json\n    materials_mode: off\n"
    (tmp_path / "scenes.yaml").write_text(text)
    row = registries.read_scenes(spark, str(tmp_path / "scenes.yaml"), str(tmp_path)).first()
    assert row.scene_id == "room" and row.navmesh == str(tmp_path / "a.navmesh") and row.materials_mode == "off" and row.stage_config is None
    for broken, said in ((text.replace("navmesh: a.", "navmesh: b."), "no file"), (text.replace("    dataset: d\n", ""), "lacks dataset"), (text.replace("mode: off", "mode: on"), "off"), ("", "no scenes")):
        (tmp_path / "scenes.yaml").write_text(broken)
        with pytest.raises(ValueError, match=said):
            registries.read_scenes(spark, str(tmp_path / "scenes.yaml"), str(tmp_path))


def test_sound_registry(spark, tmp_path):
    image = audio.write_wav(np.full((80000, 2), 0.1, np.float32), 16000)
    (tmp_path / "dry").mkdir()
    (tmp_path / "dry" / "tone.wav").write_bytes(image)
    broken = np.full((80000, 2), 0.1, np.float32)
    broken[9, 1] = np.nan
    (tmp_path / "nan.wav").write_bytes(audio.write_wav(broken, 16000))
    good = dict(audio_id="tone", event_class="bell", path="dry/tone.wav", duration_sec="5.0", sample_rate_hz="16000", channels="2", sha256=hashlib.sha256(image).hexdigest(), source_dataset="own")

    def read(*rows):
        with open(tmp_path / "sounds.csv", "w", newline="") as out:
            writer = csv.DictWriter(out, registries.SOUND_FIELDS)
            writer.writeheader()
            writer.writerows(rows)
        return registries.read_sounds(spark, str(tmp_path / "sounds.csv"), str(tmp_path))

    assert read(good).first().duration_sec == 5.0
    for change, said in (({"channels": "1"}, "channels"), ({"duration_sec": "6"}, "duration"), ({"sha256": "0"}, "hash"), ({"path": "none.wav"}, "missing"), ({"path": "nan.wav"}, "not finite"), ({"event_class": ""}, "required field")):
        with pytest.raises(ValueError, match=said):
            read({**good, **change})
    with pytest.raises(ValueError, match="repeated id"):
        read(good, good)
    with pytest.raises(ValueError, match="no sounds"):
        read()


def test_draws_depend_on_the_seed_alone():
    assert records.drawn(5, 4, 7, 25.0, 2.0, 12.0) == records.drawn(5, 4, 7, 25.0, 2.0, 12.0) != records.drawn(6, 4, 7, 25.0, 2.0, 12.0)
    drawn = [records.drawn(s, 4, 7, 25.0, 2.0, 12.0) for s in range(200)]
    assert all(2 <= d[4] <= 12 and -180 <= d[3] < 180 and 0 <= d[2] < 25 for d in drawn) and {d[0] for d in drawn} == set(range(4))
    assert records.drawn(1, 4, 7, 25.0, 90.0, 99.0)[4:] == (None, 128)


def test_episodes_of_scenes(spark, tmp_path):
    """A main document without episodes and one a scene; only what is there is read, and a missing folder has no scenes."""
    from pyspark.sql import types as T

    (tmp_path / "content").mkdir()
    for name, ids in (("train.json.gz", []), ("content/a.json.gz", [1, 2]), ("content/b.json.gz", [3])):
        (tmp_path / name).write_bytes(gzip.compress(json.dumps({"episodes": [{"episode_id": i, "goals": [{"view_points": [{"iou": 0.5}]}]} for i in ids]}).encode()))
    schema = T.StructType.fromDDL("episode_id long, goals array<struct<view_points: array<struct<iou: double>>>>")
    rows = tables.read_episode_set(spark, str(tmp_path / "train.json.gz"), schema)
    assert sorted((r.scene, r.episode_id, r.goals[0].view_points[0].iou) for r in rows.collect()) == [("a", 1, 0.5), ("a", 2, 0.5), ("b", 3, 0.5)]
    assert [r.episode_id for r in tables.read_episode_set(spark, str(tmp_path / "train.json.gz"), schema, ["b"]).collect()] == [3]
    assert [r.scene for r in tables.scenes_of(spark, str(tmp_path / "content")).collect()] == ["a", "b"]
    assert tables.scenes_of(spark, str(tmp_path / "none")).count() == 0

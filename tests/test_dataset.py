"""A dataset's folder is written, read, broken in each way, and reported."""

import json

import numpy as np
from auralake.operators import validation
from auralake.sources import dataset, formats

SOURCE = {"position_world": [1.0, 0.5, 1.0], "audio_id": "tone", "segment_start_sec": 0.0, "segment_duration_sec": 0.05, "gain_db": 0.0}
TRUTH = {"scene_id": "room", "source_position_world": [1.0, 0.5, 1.0], "dry_audio_id": "tone", "segment_start_sec": 0.0, "segment_duration_sec": 0.05, "gain_db": 0.0, "dry_hash": "h"}
RATE, DRY, TAIL = 16000, 800, 100


def manifests(n=2):
    view = lambda e, v, c, action: {
        "episode_id": e, "viewpoint_id": v, "candidate_id": c, "action_type": action, "sensor_position_world": [0.0, 1.5, 0.0], "yaw_deg": 0.0, "duration_sec": (DRY + TAIL - 1) / RATE,
        "audio_path": f"episodes/{e}/audio/{v}.wav", "rir_id": f"{e}_{v}", "rir_path": f"cache/rir/{e}_{v}.npz", "dtype": "float32", "sample_rate_hz": RATE, "num_channels": 2, "num_samples": DRY + TAIL - 1, "ground_truth": TRUTH,
    }
    ids = [f"e{i}" for i in range(n)]
    return {
        "episodes": [{"schema_version": "v0.1", "episode_id": e, "scene_id": "room", "episode_seed": 2**63 + 5, "source": SOURCE, "source_listener_euclidean_m": 2.0, "source_listener_geodesic_m": 2.5} for e in ids],
        "candidates": [{"episode_id": e, "candidate_id": f"{c}_{e}", "action_type": "turn", "valid": c == "c"} for e in ids for c in "cd"],
        "viewpoints": [view(e, *v) for e in ids for v in (("initial", None, "initial"), (f"c_{e}", f"c_{e}", "turn"))],
    }


def payloads(t):
    """Samples by WAV path and arrays by NPZ path."""
    samples = np.random.default_rng(3).normal(scale=0.1, size=(2, DRY + TAIL - 1)).astype(np.float32)
    sounds = {v["audio_path"]: {"sr": RATE, "samples": samples.copy()} for v in t["viewpoints"]}
    return sounds, {v["rir_path"]: {"rir": np.ones((TAIL, 2), np.float32), "sample_rate_hz": np.array(RATE), "num_samples": np.array(TAIL)} for v in t["viewpoints"]}


def write(spark, root, t, sounds, arrays):
    """The folder by this library's own writers."""
    formats.register(spark)
    rows = [(p, x["sr"], x["samples"].tolist()) for p, x in sounds.items()]
    spark.createDataFrame(rows, "path string, sr int, samples array<array<float>>").coalesce(2).write.format("wav").mode("append").save(root)
    rows = [(p, m, x.dtype.name, list(x.shape), x.tobytes()) for p, members in arrays.items() for m, x in members.items()]
    spark.createDataFrame(rows, "path string, member string, dtype string, shape array<long>, data binary").repartition(2, "path").sortWithinPartitions("path").write.format("npz").mode("append").save(root)
    manifest(spark, root, t)


def manifest(spark, root, t):
    texts = [(f"manifests/{name}.jsonl", "".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in own)) for name, own in t.items()]
    spark.createDataFrame(texts, "path string, content string").coalesce(1).write.format("files").mode("append").save(root)


def told(rows, level="hard"):
    return {(r.rule, r.key) for r in rows.where(f"level = '{level}'").collect()}


def test_a_sound_folder_passes(spark, tmp_path):
    t, root = manifests(), str(tmp_path / "set")
    write(spark, root, t, *payloads(t))
    row = validation.report(dataset.checked(spark, root)).first()
    assert (row.status, row.failures, row.warnings) == ("PASS", [], [])
    assert told(dataset.checked(spark, root, finished=True)) == {("_SUCCESS is missing", "_SUCCESS")}
    assert {r.complete for r in dataset.complete(spark, root).collect()} == {True}


#: What is done to a viewpoint's sound, its arrays and its row, and what is told of it.
BROKEN = [
    (lambda s, a, v: s["samples"].__setitem__((1, 5), np.nan), {"WAV not finite"}),
    (lambda s, a, v: s.update(sr=8000), {"WAV sample rate/channel", "manifest/WAV metadata"}),
    (lambda s, a, v: s.update(samples=s["samples"][:1]), {"WAV sample rate/channel", "manifest/WAV metadata"}),
    (lambda s, a, v: v.update(num_channels=1), {"manifest/WAV metadata"}),
    (lambda s, a, v: v.update(audio_path="episodes/none.wav"), {"missing manifest audio"}),
    (lambda s, a, v: v.update(rir_id=None), {"missing RIR reference"}),
    (lambda s, a, v: a.update(rir=np.ones((TAIL, 2))), {"RIR metadata/array"}),
    (lambda s, a, v: a.update(rir=np.ones((TAIL, 3), np.float32)), {"RIR metadata/array"}),
    (lambda s, a, v: a.update(rir=np.full((TAIL, 2), np.inf, np.float32)), {"RIR metadata/array"}),
    (lambda s, a, v: a.update(rir=np.ones(TAIL, np.float32)), {"unreadable RIR"}),
    (lambda s, a, v: a.update(rir=np.ones((TAIL + 1, 2), np.float32)), {"RIR metadata/array", "full convolution length"}),
    (lambda s, a, v: a.update(num_samples=np.array(TAIL - 1)), {"RIR metadata/array"}),
    (lambda s, a, v: a.pop("num_samples"), {"unreadable RIR"}),
    (lambda s, a, v: v.update(rir_path="cache/rir/none.npz"), {"unreadable RIR"}),
    (lambda s, a, v: v.update(action_type="move"), {"candidate/viewpoint relation"}),
    (lambda s, a, v: v.update(ground_truth={**TRUTH, "gain_db": 3.0}), {"ground_truth/episode"}),
]


def test_each_broken_viewpoint_is_told(spark, tmp_path):
    t, root = manifests(len(BROKEN) + 3), str(tmp_path / "set")
    sounds, arrays = payloads(t)
    rows = {v["episode_id"]: v for v in t["viewpoints"] if v["candidate_id"]}
    want = set()
    for i, (change, rules) in enumerate(BROKEN):
        v = rows[f"e{i}"]
        before = dict(v)
        change(sounds[v["audio_path"]], arrays[v["rir_path"]], v)
        want |= {(rule, v["viewpoint_id"]) for rule in rules}
        want |= {("orphan payload", before[k]) for k in ("audio_path", "rir_path") if v[k] != before[k]}
    n = len(BROKEN)
    want.add(("same episode dry segment", f"e{n - 1}"))
    t["viewpoints"] = [v for v in t["viewpoints"] if (v["episode_id"], v["viewpoint_id"]) != (f"e{n}", "initial")]
    want |= {("exactly one initial viewpoint", f"e{n}"), ("orphan payload", f"episodes/e{n}/audio/initial.wav"), ("orphan payload", f"cache/rir/e{n}_initial.npz")}
    t["candidates"] += [t["candidates"][0], {**t["candidates"][0], "episode_id": "ep_missing", "candidate_id": "lost", "valid": False}]
    want |= {("duplicate or missing candidate key", "c_e0"), ("candidate references missing episode", "lost")}
    t["episodes"][n + 1]["source"] = {**SOURCE, "segment_duration_sec": 0.06}  # the ground truth of both viewpoints is wrong, the length is that of it
    want |= {(rule, v) for v in ("initial", f"c_e{n + 1}") for rule in ("ground_truth/episode", "full convolution length")}
    loud, low = rows[f"e{n + 2}"], rows[f"e{n + 1}"]
    sounds[loud["audio_path"]]["samples"] *= 100
    sounds[low["audio_path"]]["samples"] *= 1e-9
    write(spark, root, t, sounds, arrays)
    found = dataset.checked(spark, root)
    assert told(found) == want
    assert told(found, "warning") == {("peak above 1", loud["viewpoint_id"]), ("very low RMS", low["viewpoint_id"])}
    state = {r.viewpoint_id for r in dataset.complete(spark, root).collect() if not r.complete}
    assert state == {f"c_e{i}" for i in range(n - 2)}


def test_unreadable_manifests(spark, tmp_path):
    def of(name, change):
        t, root = manifests(1), str(tmp_path / name)
        change(t)
        manifest(spark, root, t)
        return told(dataset.checked(spark, root))

    assert of("cut", lambda t: t["episodes"].append('{"episode_id": \n')) == {("manifest read failure", "episodes.jsonl:2")}
    assert of("list", lambda t: t["viewpoints"].insert(0, "[]\n")) == {("manifest read failure", "viewpoints.jsonl:1")}
    assert of("gone", lambda t: t.pop("candidates")) == {("manifest read failure", "candidates.jsonl")}
    assert ("episode manifest is empty", "episodes.jsonl") in of("empty", lambda t: t["episodes"].clear())

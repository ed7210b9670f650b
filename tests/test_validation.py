"""Each broken rule of a dataset shows, and a sound one passes."""

import pytest
from pyspark.sql import functions as F

from auralake.operators import validation

SOURCE = "struct<position_world:array<double>,audio_id:string,segment_start_sec:double,segment_duration_sec:double,gain_db:double>"
EPISODE = f"episode_id string, scene_id string, source {SOURCE}, source_listener_euclidean_m double, source_listener_geodesic_m double"
CANDIDATE = "episode_id string, candidate_id string, action_type string, valid boolean, move_euclidean_m double, move_geodesic_m double"
TRUTH = "struct<scene_id:string,source_position_world:array<double>,dry_audio_id:string,segment_start_sec:double,segment_duration_sec:double,gain_db:double,dry_hash:string>"
VIEWPOINT = f"episode_id string, viewpoint_id string, candidate_id string, action_type string, sensor_position_world array<double>, yaw_deg double, duration_sec double, audio_path string, rir_id string, rir_path string, dtype string, sample_rate_hz int, num_channels int, num_samples int, ground_truth {TRUTH}"
FILE = "path string, sr int, channels int, n int, dtype string, finite boolean, peak double, rms double, error string"


def tables():
    source, truth = ([1.0, 1.5, -2.0], "tone", 0.0, 5.0, 0.0), ("room", [1.0, 1.5, -2.0], "tone", 0.0, 5.0, 0.0, "h")
    n = 80000 + 100 - 1
    view = lambda v, c, action, x: ["e1", v, c, action, [x, 1.5, 0.0], 0.0, n / 16000, f"audio/{v}.wav", f"r_{v}", f"rir/{v}.npz", "float32", 16000, 2, n, truth]
    return {
        "episodes": [["e1", "room", source, 2.2, 2.5]],
        "candidates": [["e1", "c1", "turn", True, 0.0, 0.0], ["e1", "c2", "move", False, 1.0, None]],
        "viewpoints": [view("initial", None, "initial", 0.0), view("c1", "c1", "turn", 1.0)],
        "audio": [[f"audio/{v}.wav", 16000, 2, n, "float32", True, 0.5, 0.1, None] for v in ("initial", "c1")],
        "rirs": [[f"rir/{v}.npz", 16000, 2, 100, "float32", True, 0.5, 0.1, None] for v in ("initial", "c1")],
    }


def findings(spark, t):
    frame = {k: spark.createDataFrame(t[k], s) for k, s in (("episodes", EPISODE), ("candidates", CANDIDATE), ("viewpoints", VIEWPOINT), ("audio", FILE), ("rirs", FILE))}
    rows = validation.relations(frame["episodes"], frame["candidates"], frame["viewpoints"]).unionByName(validation.payloads(frame["viewpoints"], frame["audio"], frame["rirs"]))
    files = frame["audio"].select("path").unionByName(frame["rirs"].select("path"))
    return frame, rows.unionByName(validation.orphans(frame["viewpoints"], files))


def test_a_sound_dataset_passes(spark):
    frame, rows = findings(spark, tables())
    row = validation.report(rows, episode=frame["episodes"], viewpoint=frame["viewpoints"]).first()
    assert (row.status, row.failures, row.warnings, row.episode_count, row.viewpoint_count) == ("PASS", [], [], 1, 2)


def change(table, row, at, value):
    def broken(t):
        t[table][row][at] = value

    return broken


@pytest.mark.parametrize(
    ("broken", "rules"),
    [
        (lambda t: t["viewpoints"].pop(0), {"exactly one initial viewpoint"}),
        (lambda t: t["candidates"].append(t["candidates"][0]), {"duplicate or missing candidate key"}),
        (change("viewpoints", 1, 3, "move"), {"candidate/viewpoint relation"}),
        (change("viewpoints", 1, 12, 1), {"manifest/WAV metadata"}),
        (change("viewpoints", 1, 14, ("room", [1.0, 1.5, -2.0], "tone", 0.0, 5.0, 6.0, "h")), {"ground_truth/episode", "same episode dry segment"}),
        (change("candidates", 1, 0, "gone"), {"candidate references missing episode"}),
        (change("candidates", 1, 3, True), {"valid candidate without one viewpoint"}),
        (change("candidates", 0, 3, False), {"invalid candidate has viewpoint", "candidate/viewpoint relation"}),
        (change("episodes", 0, 4, float("nan")), {"sampled episode needs a finite source_listener_geodesic_m"}),
        (change("viewpoints", 0, 3, "turn"), {"initial viewpoint contract"}),
        (change("viewpoints", 1, 8, None), {"missing RIR reference"}),
        (lambda t: t["audio"].append(["audio/x.wav", *t["audio"][0][1:]]), {"orphan payload"}),
        (lambda t: t["audio"].pop(), {"missing manifest audio"}),
        (change("audio", 0, 8, "cut off"), {"unreadable audio"}),
        (change("audio", 0, 5, False), {"WAV not finite"}),
        (change("rirs", 0, 3, 90), {"full convolution length"}),
        (change("audio", 0, 6, 1.5), {"peak above 1"}),
        (change("audio", 0, 7, 1e-9), {"very low RMS"}),
    ],
)
def test_each_rule(spark, broken, rules):
    t = tables()
    broken(t)
    _, rows = findings(spark, t)
    row = validation.report(rows).first()
    names = {f.rule for f in [*row.failures, *row.warnings]}
    if any("initial" == v[1] for v in t["viewpoints"]):
        assert rules <= names and len(names - rules) <= (1 if "orphan payload" not in names else 1)
    assert rules <= names and row.status == ("PASS" if {"peak above 1", "very low RMS"} & rules else "FAIL")


def test_comparisons(spark):
    t = tables()
    frame, _ = findings(spark, t)
    metrics = spark.createDataFrame([("e1", "initial", -20.0), ("e1", "c1", -17.0)], "episode_id string, viewpoint_id string, rms_db double")
    row = validation.comparisons(frame["episodes"], frame["candidates"], frame["viewpoints"], metrics, ["rms_db"]).first()
    assert row.delta_rms_db == 3.0 and row.initial_source_distance_m == pytest.approx(5**0.5) and row.candidate_source_distance_m == 2.0
    assert row.initial_relative_azimuth_deg == pytest.approx(26.565, abs=1e-3) and row.delta_relative_azimuth_deg == pytest.approx(-26.565, abs=1e-3)
    assert validation.comparisons(frame["episodes"], frame["candidates"], frame["viewpoints"], metrics.where("viewpoint_id = 'initial'"), ["rms_db"]).count() == 0
    with pytest.raises(ValueError, match="initial"):
        validation.comparisons(frame["episodes"], frame["candidates"], frame["viewpoints"], metrics.where("viewpoint_id = 'c1'"), ["rms_db"])


def test_channel_order(spark):
    rows = [("left", 0, 2.0, 2.0, 2.0), ("left", 1, 1.0, 1.0, 1.0), ("right", 0, 1.0, 1.0, 1.0), ("right", 1, 2.0, 2.0, 2.0)]
    stats = spark.createDataFrame(rows, "source string, channel int, energy double, rms double, peak double")
    assert validation.channel_order(stats).first().passed
    assert not validation.channel_order(stats.withColumn("peak", F.when((F.col("source") == "left") & (F.col("channel") == 1), 3.0).otherwise(F.col("peak")))).first().passed
    assert not validation.channel_order(stats.where("source = 'left'")).first().passed

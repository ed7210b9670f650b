"""Rules that a dataset of episodes, candidates and viewpoints must hold, each as rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pose
from ..sources.tables import finite
from .joins import violations

KEYS = {"episode": ["episode_id"], "candidate": ["episode_id", "candidate_id"], "viewpoint": ["episode_id", "viewpoint_id"]}
#: What a viewpoint repeats of its episode: field of ``ground_truth`` -> expression over the episode.
REPEATED = {
    "scene_id": "scene_id", "source_position_world": "source.position_world", "dry_audio_id": "source.audio_id",
    "segment_start_sec": "source.segment_start_sec", "segment_duration_sec": "source.segment_duration_sec", "gain_db": "source.gain_db",
}
DRY = ("dry_audio_id", "segment_start_sec", "segment_duration_sec", "gain_db", "dry_hash")


def _rows(rows: DataFrame, rule: str, key: str, broken: Column, level: str = "hard") -> DataFrame:
    return rows.where(F.coalesce(broken, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(level).alias("level"))


def relations(episodes: DataFrame, candidates: DataFrame, viewpoints: DataFrame, sampled: bool = True) -> DataFrame:
    """(rule, key, level) of the manifests: keys, references, initial viewpoints, and what viewpoints repeat of their episode."""
    found = [_rows(violations(rows, KEYS[kind]), f"duplicate or missing {kind} key", KEYS[kind][-1], F.lit(True)) for kind, rows in (("episode", episodes), ("candidate", candidates), ("viewpoint", viewpoints))]
    known = episodes.select("episode_id", F.lit(True).alias("known")).distinct()
    for kind, rows in (("candidate", candidates), ("viewpoint", viewpoints)):
        found.append(_rows(rows.join(known, "episode_id", "left"), f"{kind} references missing episode", KEYS[kind][-1], F.col("known").isNull()))
    if sampled:
        for c in ("source_listener_euclidean_m", "source_listener_geodesic_m"):
            found.append(_rows(episodes, f"sampled episode needs a finite {c}", "episode_id", ~finite(F.col(c).try_cast("double")) if dict(episodes.dtypes)[c] != "boolean" else F.lit(True)))
    first = viewpoints.where("viewpoint_id = 'initial'")
    counted = episodes.join(first.groupBy("episode_id").agg(F.count("*").alias("n")), "episode_id", "left")
    found.append(_rows(counted, "exactly one initial viewpoint", "episode_id", F.coalesce("n", F.lit(0)) != 1))
    found.append(_rows(first, "initial viewpoint contract", "episode_id", F.col("candidate_id").isNotNull() | ~F.col("action_type").eqNullSafe("initial")))
    seen = viewpoints.groupBy("episode_id", F.col("viewpoint_id").alias("candidate_id")).agg(F.count("*").alias("n"))
    offered = candidates.join(seen, ["episode_id", "candidate_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found.append(_rows(offered, "valid candidate without one viewpoint", "candidate_id", F.col("valid") & (F.col("n") != 1)))
    found.append(_rows(offered, "invalid candidate has viewpoint", "candidate_id", ~F.coalesce("valid", F.lit(False)) & (F.col("n") > 0)))
    own = candidates.select("episode_id", "candidate_id", F.col("valid").alias("c_valid"), F.col("action_type").alias("c_action"), F.lit(True).alias("found"))
    shown = viewpoints.where("viewpoint_id <> 'initial'").join(known, "episode_id").join(own, ["episode_id", "candidate_id"], "left")
    found.append(_rows(shown, "viewpoint references missing candidate", "viewpoint_id", F.col("found").isNull()))
    unlike = ~F.coalesce("c_valid", F.lit(False)) | (F.col("viewpoint_id") != F.col("candidate_id")) | ~F.col("action_type").eqNullSafe(F.col("c_action"))
    found.append(_rows(shown, "candidate/viewpoint relation", "viewpoint_id", F.col("found") & unlike))
    truth = viewpoints.join(episodes.select("episode_id", *[F.col(e).alias(f"e_{k}") for k, e in REPEATED.items()]), "episode_id")
    differs = F.lit(False)
    for k in REPEATED:
        differs = differs | ~F.col(f"ground_truth.{k}").eqNullSafe(F.col(f"e_{k}"))
    found.append(_rows(truth, "ground_truth/episode", "viewpoint_id", differs))
    dry = viewpoints.groupBy("episode_id").agg(F.size(F.collect_set(F.struct(*[F.coalesce(F.col(f"ground_truth.{k}").cast("string"), F.lit("")).alias(k) for k in DRY]))).alias("n"))
    found.append(_rows(dry, "same episode dry segment", "episode_id", F.col("n") > 1))
    return _all(found)


def _tested(viewpoints: DataFrame, audio: DataFrame, rirs: DataFrame | None, rate: Column, dry_seconds: Column) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """``viewpoints`` with what is known of their files, and the columns that tell which hard rules and which warnings hold of a row."""
    a = viewpoints.join(audio.select(F.col("path").alias("audio_path"), F.struct("sr", "channels", "n", "dtype", "finite", "peak", "rms", "error").alias("a")), "audio_path", "left")
    there, read = F.col("a").isNotNull(), F.col("a.error").isNull() & F.col("a").isNotNull()
    stated = (F.col("sample_rate_hz") != F.col("a.sr")) | (F.col("num_channels") != F.col("a.channels")) | (F.col("num_samples") != F.col("a.n")) | (F.abs(F.col("duration_sec") - F.col("a.n") / F.col("a.sr")) > 1e-6)
    hard = {
        "missing manifest audio": ~there | F.col("audio_path").startswith("/"),
        "unreadable audio": there & F.col("a.error").isNotNull(),
        "WAV sample rate/channel": read & ((F.col("a.sr") != rate) | (F.col("a.channels") != 2)),
        "WAV dtype": read & ((F.col("a.dtype") != "float32") | ~F.col("dtype").eqNullSafe("float32")),
        "WAV not finite": read & ~F.col("a.finite"),
        "manifest/WAV metadata": read & F.coalesce(stated, F.lit(True)),
    }
    warnings = {"peak above 1": read & (F.col("a.peak") > 1), "very low RMS": read & (F.col("a.rms") > 0) & (F.col("a.rms") < 1e-8)}
    if rirs is None:
        return a, hard, warnings
    count = F.col("count") if "count" in rirs.columns else F.col("n")
    b = a.join(rirs.select(F.col("path").alias("rir_path"), F.struct("sr", "channels", "n", "dtype", "finite", "error", count.cast("long").alias("count")).alias("r")), "rir_path", "left")
    named, ok = F.col("rir_id").isNotNull() & F.col("rir_path").isNotNull(), F.col("r").isNotNull() & F.col("r.error").isNull()
    dry, finite_r = F.round(dry_seconds * rate), F.coalesce("r.finite", F.lit(False))
    wrong = (F.col("r.sr") != rate) | (F.col("r.channels") != 2) | (F.col("r.dtype") != "float32") | ~finite_r | (F.col("r.count") != F.col("r.n"))
    hard |= {
        "missing RIR reference": ~named,
        "unreadable RIR": named & ~F.coalesce(ok, F.lit(False)),
        "RIR metadata/array": ok & F.coalesce(wrong, F.lit(True)),
        "full convolution length": ok & read & F.coalesce((dry <= 0) | (F.col("a.n") != dry + F.col("r.n") - 1), F.lit(True)),
    }
    return b, hard, warnings


def payloads(viewpoints: DataFrame, audio: DataFrame, rirs: DataFrame | None, rate: int = 16000, episodes: DataFrame | None = None) -> DataFrame:
    """(rule, key, level) of the files behind viewpoints.

    ``audio`` and ``rirs``: (path, sr, channels, n, dtype, finite, peak, rms, error), a row for each file that is there,
    as ``sources.dataset`` makes them; ``rirs`` may have ``count``, the number of samples that the file states. The length of
    the dry sound is that of the episode's source; where no episodes are given, that which the viewpoint repeats of it.
    """
    dry = F.col("ground_truth.segment_duration_sec")
    if episodes is not None:
        viewpoints = viewpoints.join(episodes.select("episode_id", F.col("source.segment_duration_sec").alias("_dry")).dropDuplicates(["episode_id"]), "episode_id", "left")
        dry = F.col("_dry")
    rows, hard, warnings = _tested(viewpoints, audio, rirs, F.lit(rate), dry)
    told = F.array(*[F.when(F.coalesce(v, F.lit(False)), F.struct(F.lit(k).alias("rule"), F.lit(level).alias("level"))) for level, rules in (("hard", hard), ("warning", warnings)) for k, v in rules.items()])
    return rows.select(F.col("viewpoint_id").cast("string").alias("key"), F.explode(F.array_compact(told)).alias("f")).select("f.rule", "key", "f.level")


def complete(viewpoints: DataFrame, audio: DataFrame, rirs: DataFrame | None) -> DataFrame:
    """(episode_id, viewpoint_id, complete): whether a viewpoint's files are there and as it says, so that a run that goes on may skip it."""
    rows, hard, _ = _tested(viewpoints, audio, rirs, F.col("sample_rate_hz"), F.col("ground_truth.segment_duration_sec"))
    broken = F.lit(False)
    for rule in hard.values():
        broken = broken | F.coalesce(rule, F.lit(False))
    return rows.select("episode_id", "viewpoint_id", (~broken).alias("complete"))


def orphans(viewpoints: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, key, level): files (path) that no viewpoint names, of audio and of responses."""
    named = viewpoints.select(F.col("audio_path").alias("path")).unionByName(viewpoints.select(F.col("rir_path").alias("path")))
    return _rows(files.select("path").join(named, "path", "left_anti"), "orphan payload", "path", F.lit(True))


def _all(found: list[DataFrame]) -> DataFrame:
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def report(findings: DataFrame, **counted: DataFrame) -> DataFrame:
    """One row: status (FAIL if a hard rule is broken), failures and warnings as counts by rule with a first key, and the number of rows of each table."""
    rules = findings.groupBy("level", "rule").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    listed = lambda level: F.sort_array(F.collect_list(F.when(F.col("level") == level, F.struct("rule", "n", "first"))))
    row = rules.agg(F.when(F.count_if(F.col("level") == "hard") > 0, "FAIL").otherwise("PASS").alias("status"), listed("hard").alias("failures"), listed("warning").alias("warnings"))
    return row.select("*", *[table.agg(F.count("*").alias("n")).scalar().alias(f"{name}_count") for name, table in counted.items()])


def comparisons(episodes: DataFrame, candidates: DataFrame, viewpoints: DataFrame, metrics: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each valid candidate that has a viewpoint and metrics: its distance, azimuth and ``fields`` against the initial viewpoint's.

    ValueError if an episode lacks an initial viewpoint with metrics; candidates without them are left out.
    """
    keys = ["episode_id", "viewpoint_id"]
    seen = viewpoints.join(metrics.select(*keys, *fields), keys).join(episodes.select("episode_id", F.col("source.position_world").alias("s")), "episode_id")
    off = [F.col("s")[i] - F.col("sensor_position_world")[i] for i in range(3)]
    seen = seen.select(*keys, F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]).alias("source_distance_m"), pose.azimuth(off[0], off[2], F.col("yaw_deg")).alias("relative_azimuth_deg"), *fields)
    values = ["source_distance_m", "relative_azimuth_deg", *fields]
    first = seen.where("viewpoint_id = 'initial'").select("episode_id", *[F.col(v).cast("double").alias(f"initial_{v}") for v in values])
    lost = episodes.join(first, "episode_id", "left_anti").select("episode_id").first()
    if lost is not None:
        raise ValueError(f"no initial viewpoint to compare with: {lost[0]}")
    offered = candidates.where("valid").select("episode_id", "candidate_id", "action_type", F.coalesce("move_euclidean_m", F.lit(0.0)).alias("movement_euclidean_m"), F.col("move_geodesic_m").alias("movement_geodesic_m"))
    both = offered.join(seen.select("episode_id", F.col("viewpoint_id").alias("candidate_id"), *[F.col(v).cast("double").alias(f"candidate_{v}") for v in values]), ["episode_id", "candidate_id"]).join(first, "episode_id")
    delta = lambda v: F.col(f"candidate_{v}") - F.col(f"initial_{v}")
    return both.withColumns({f"delta_{v}": pose.normalize_yaw(delta(v)) if v == "relative_azimuth_deg" else delta(v) for v in values})


def channel_order(stats: DataFrame) -> DataFrame:
    """(left_dominant, right_dominant, passed) of ``stats`` (source, channel, energy, rms, peak): a source on one side must be louder there in all three."""
    louder = lambda side, c, d: F.min(F.when(F.col("source") == side, (F.col(f"{c}_e") > F.col(f"{d}_e")) & (F.col(f"{c}_r") > F.col(f"{d}_r")) & (F.col(f"{c}_p") > F.col(f"{d}_p"))))
    one = lambda channel, name, v: F.max(F.when(F.col("channel") == channel, F.col(v))).alias(name)
    wide = stats.groupBy("source").agg(*[one(i, f"c{i}_{v[0]}", v) for i in (0, 1) for v in ("energy", "rms", "peak")])
    both = wide.agg(F.coalesce(louder("left", "c0", "c1"), F.lit(False)).alias("left_dominant"), F.coalesce(louder("right", "c1", "c0"), F.lit(False)).alias("right_dominant"))
    return both.withColumn("passed", F.col("left_dominant") & F.col("right_dominant"))

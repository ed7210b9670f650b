"""A dataset's folder: manifests of JSON lines, sounds and responses, checked from end to end.

Below the folder lie ``manifests/episodes.jsonl``, ``candidates.jsonl`` and ``viewpoints.jsonl``, the
WAV and NPZ files that viewpoints name, and ``_SUCCESS`` when it is finished. Each payload is read
once, by tasks that give its statistics and not its samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import validation
from .formats import listed, register, store_of
from .tables import located, numbered_lines

_TRUTH = "struct<scene_id:string,source_position_world:array<double>,dry_audio_id:string,segment_start_sec:double,segment_duration_sec:double,gain_db:double,dry_hash:string>"
_SOURCE = "struct<position_world:array<double>,audio_id:string,segment_start_sec:double,segment_duration_sec:double,gain_db:double>"
# The manifests and their fields.
MANIFESTS = {
    "episodes": f"schema_version string, episode_id string, scene_id string, episode_seed decimal(20,0), source {_SOURCE}, "
    "listener_initial struct<base_position_world:array<double>,sensor_position_world:array<double>,yaw_deg:double>, source_listener_euclidean_m double, source_listener_geodesic_m double",
    "candidates": "episode_id string, candidate_id string, action_type string, translation_direction string, requested_translation_m double, rotation_deg double, requested_base_position_world array<double>, "
    "snapped_base_position_world array<double>, sensor_position_world array<double>, yaw_deg double, snap_error_m double, move_euclidean_m double, move_geodesic_m double, is_navigable boolean, has_path boolean, valid boolean, "
    "path_points_world array<array<double>>, invalid_reason string",
    "viewpoints": "episode_id string, viewpoint_id string, candidate_id string, action_type string, base_position_world array<double>, sensor_position_world array<double>, yaw_deg double, duration_sec double, "
    f"audio_path string, rir_id string, rir_path string, dtype string, sample_rate_hz int, num_channels int, num_samples int, ground_truth {_TRUTH}",
}
#: What is known of a WAV file without keeping its samples.
AUDIO = "path string, sr int, channels int, n long, dtype string, finite boolean, peak double, rms double, error string"


def _below(root: str):
    """A file's path below the folder."""
    return F.substring(F.col("path"), len(store_of(root)[1].rstrip("/")) + 2, 1 << 30)


def audio_files(spark: SparkSession, root: str) -> DataFrame:
    """A row of statistics over all channels for each WAV file of the folder, by its path below it."""
    register(spark)
    return spark.read.format("wav").schema(AUDIO).load(root).withColumn("path", _below(root))


def response_files(spark: SparkSession, root: str) -> DataFrame:
    """The same for each NPZ file with a response: the array ``rir`` of (samples, channels), its rate and the number of samples that it states."""
    register(spark)
    members = spark.read.format("npz").schema("path string, member string, dtype string, shape array<long>, finite boolean, peak double, rms double, number double, error string").load(root)
    of = lambda member, value: F.max(F.when(F.col("member") == member, value))
    row = members.groupBy("path").agg(
        of("sample_rate_hz", F.col("number")).cast("int").alias("sr"), of("rir", F.size("shape")).alias("dimensions"), of("rir", F.get("shape", F.lit(1))).cast("int").alias("channels"), of("rir", F.get("shape", F.lit(0))).alias("n"),
        of("rir", F.col("dtype")).alias("dtype"), of("rir", F.col("finite")).alias("finite"), of("rir", F.col("peak")).alias("peak"), of("rir", F.col("rms")).alias("rms"), of("num_samples", F.col("number")).cast("long").alias("count"), F.max("error").alias("said"),
    )
    lacking = F.when(F.col("dimensions").isNull() | F.col("sr").isNull() | F.col("count").isNull(), "a member is missing").when(F.col("dimensions") != 2, "the response is no table of samples and channels")
    return row.select(_below(root).alias("path"), "sr", "channels", "n", "dtype", "finite", "peak", "rms", "count", F.coalesce("said", lacking).alias("error"))


def manifest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, line, row, broken) of a manifest."""
    return located(numbered_lines(spark, f"{root}/manifests/{name}.jsonl"), MANIFESTS[name])


def checked(spark: SparkSession, root: str, rate: int = 16000, finished: bool = False, sampled: bool = True, responses: bool = True) -> DataFrame:
    """(rule, key, level) of all that is wrong with the dataset of the folder ``root``.

    ``finished``: its mark must be there. ``sampled``: episodes must have finite distances. ``responses``: viewpoints must name
    them. Manifests that are missing or have a line that is no row are all that is told, as the other rules need their rows.
    """
    told = []
    if finished:
        store, place = store_of(root)
        if not store.get_file_info(f"{place}/_SUCCESS").is_file:
            told.append(("_SUCCESS is missing", "_SUCCESS"))
    missing = [name for name in MANIFESTS if not _there(root, name)]
    told += [("manifest read failure", f"{name}.jsonl") for name in missing]
    own = spark.createDataFrame([(r, k, "hard") for r, k in told], "rule string, key string, level string")
    if missing:
        return own
    read = {name: manifest(spark, root, name) for name in MANIFESTS}
    broken = [rows.where("broken is not null").select(F.lit("manifest read failure").alias("rule"), F.concat(F.lit(f"{name}.jsonl:"), F.col("line")).alias("key"), F.lit("hard").alias("level")) for name, rows in read.items()]
    faults = own.unionByName(broken[0]).unionByName(broken[1]).unionByName(broken[2])
    if not broken[0].unionByName(broken[1]).unionByName(broken[2]).isEmpty():
        return faults
    episodes, candidates, viewpoints = (read[name].select("row.*") for name in MANIFESTS)
    if episodes.isEmpty():
        faults = faults.unionByName(spark.createDataFrame([("episode manifest is empty", "episodes.jsonl", "hard")], "rule string, key string, level string"))
    audio, rirs = audio_files(spark, root), response_files(spark, root) if responses else None
    files = audio.select("path") if rirs is None else audio.select("path").unionByName(rirs.select("path"))
    found = validation.relations(episodes, candidates, viewpoints, sampled).unionByName(validation.payloads(viewpoints, audio, rirs, rate, episodes)).unionByName(validation.orphans(viewpoints, files))
    return faults.unionByName(found)


def _there(root: str, name: str) -> bool:
    try:
        return bool(listed(f"{root}/manifests/{name}.jsonl", ""))
    except FileNotFoundError:
        return False


def complete(spark: SparkSession, root: str, responses: bool = True) -> DataFrame:
    """(episode_id, viewpoint_id, complete): which viewpoints of an unfinished run have all their files."""
    viewpoints = manifest(spark, root, "viewpoints").where("broken is null").select("row.*")
    return validation.complete(viewpoints, audio_files(spark, root), response_files(spark, root) if responses else None)


def _lag(left: Column, right: Column) -> Column:
    """The best correlation of both ears, negated, and its lag; of equal ones the shortest lag."""
    found = signal.lagged_correlations(signal.doubles(left), signal.doubles(right), signal.MOST_LAG)
    return F.array_min(F.transform(found, lambda x, i: F.struct((-x).alias("c"), F.abs(i - signal.MOST_LAG).alias("a"), (i - signal.MOST_LAG).alias("lag"))))


def waveform_metrics(spark: SparkSession, root: str) -> DataFrame:
    """(path, fault, measures) of each WAV file: the measures of its window, or why it has none."""
    register(spark)
    sounds = spark.read.format("wav").schema(f"{AUDIO}, left array<float>, right array<float>").load(root)
    fault = F.coalesce(F.when(F.col("error").isNotNull(), "unreadable"), signal.window_fault(*map(F.col, ("sr", "channels", "dtype", "finite", "n"))))
    able = sounds.select(_below(root).alias("path"), fault.alias("fault"), *[F.when(fault.isNull(), F.slice(c, 1, signal.WINDOW)).alias(f"w_{c}") for c in ("left", "right")], *[F.when(fault.isNull(), F.col(c)).alias(c) for c in ("left", "right")])
    best = able.select("path", "fault", signal.window_metrics(F.col("left"), F.col("right")).alias("m"), _lag(F.col("w_left"), F.col("w_right")).alias("b"))
    return best.select("path", "fault", "m.*", (-F.col("b.c")).alias("interaural_correlation"), F.col("b.lag").alias("interaural_lag_samples"))

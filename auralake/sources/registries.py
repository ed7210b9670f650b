"""Registries: the scenes and dry sounds that a run may use, checked when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import audited
from .formats import register

# What each entry must say.
SCENE_FIELDS = ["dataset", "scene_asset", "navmesh", "semantic_info", "materials_mode"]
SOUND_FIELDS = ["audio_id", "event_class", "path", "duration_sec", "sample_rate_hz", "channels", "sha256", "source_dataset"]
# The fields of a scene that name files.
SCENE_FILES = ["scene_asset", "navmesh", "semantic_info", "stage_config"]


def scene_problems(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(scene_id, problem) of ``entries`` (scene_id, field, value), a row for each field that a scene has, against ``files`` (path) below the root."""
    said = entries.where("value is not null")
    known = said.groupBy("scene_id").agg(F.collect_set("field").alias("has"))
    lacking = entries.select("scene_id").distinct().join(known, "scene_id", "left").select("scene_id", F.explode(F.array_except(F.array(*map(F.lit, SCENE_FIELDS)), F.coalesce("has", F.array().cast("array<string>")))).alias("field"))
    lost = said.where(F.col("field").isin(SCENE_FILES)).join(files.select(F.col("path").alias("value")), "value", "left_anti")
    modes = said.where("field = 'materials_mode' and lower(value) not in ('off', 'false')")
    return (
        lacking.select("scene_id", F.concat(F.lit("lacks "), "field").alias("problem"))
        .unionByName(lost.select("scene_id", F.concat(F.lit("no file "), "value").alias("problem")))
        .unionByName(modes.select("scene_id", F.lit("materials must be off").alias("problem")))
    )


def read_scenes(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(scene_id, the fields, stage_config) of a YAML registry, whose files lie below ``root``; a scene a row.

    ValueError for an empty registry and for the first entries that break a rule.
    """
    import yaml

    register(spark)
    content = spark.read.text(path, wholetext=True).first()
    scenes = (yaml.safe_load(content.value) if content else None) or {}
    entries = [(s, k, None if v is None else str(v)) for s, fields in (scenes.get("scenes") or {}).items() for k, v in {"": "", **(fields or {})}.items()]
    if not entries:
        raise ValueError("no scenes are registered")
    rows = spark.createDataFrame(entries, "scene_id string, field string, value string")
    base = root.rstrip("/")
    files = spark.read.format("files").schema("path string").load(base).select(F.substring("path", len(base) + 2, 1 << 30).alias("path"))
    problems = scene_problems(rows, files).orderBy("scene_id", "problem").take(5)
    if problems:
        raise ValueError("; ".join(f"scene {p.scene_id}: {p.problem}" for p in problems))
    wide = rows.groupBy("scene_id").pivot("field", [*SCENE_FIELDS, "stage_config"]).agg(F.first("value"))
    return wide.withColumn("materials_mode", F.lit("off")).withColumns({c: F.concat(F.lit(f"{base}/"), F.col(c)) for c in SCENE_FILES})


def read_sounds(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The rows of a CSV registry of dry sounds, numbers cast, each row checked against its file below ``root``.

    ValueError for an empty registry and for the first rows that break a rule.
    """
    raw = spark.read.option("header", True).csv(path)
    lacking = [k for k in SOUND_FIELDS if k not in raw.columns]
    if lacking:
        raise ValueError(f"the registry lacks {', '.join(lacking)}")
    blank = F.lit(False)
    for k in SOUND_FIELDS:
        blank = blank | (F.coalesce(F.col(k), F.lit("")) == "")
    if not raw.where(blank).isEmpty():
        raise ValueError("a sound is missing a required field")
    rows = raw.withColumns({"duration_sec": F.col("duration_sec").cast("double"), "sample_rate_hz": F.col("sample_rate_hz").cast("int"), "channels": F.col("channels").cast("int")})
    if rows.isEmpty():
        raise ValueError("no sounds are registered")
    register(spark)
    files = spark.read.format("wav").schema("path string, sr int, n long, channels int, finite boolean, sha256 string, error string").load(root)
    problems = audited(rows, files).orderBy("audio_id", "problem").take(5)
    if problems:
        raise ValueError("; ".join(f"{p.audio_id}: {p.problem}" for p in problems))
    return rows

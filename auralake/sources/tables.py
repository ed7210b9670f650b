"""Reading tables and text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.rounds import kept

#: Rows of a table of splits up to which it is sent to all tasks: some 100 MB.
MOST_SPLITS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parse_jsonl(lines: DataFrame, schema: T.StructType | str, line: str = "value") -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a malformed line ends the query with an error."""
    return lines.where(F.trim(line) != "").select(F.from_json(line, schema, {"mode": "FAILFAST"}).alias("_row")).select("_row.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files, lines counted from 1 in each file, however it is split.

    Each split's lines are counted first, in a pass of its own. What that gives, one row a split, is
    sent to all tasks up to ``MOST_SPLITS`` rows, beyond which lines are shuffled to it.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = kept(splits.select("path", "block", (before - F.col("first") + 1).alias("moved")))
    return rows.join(F.broadcast(moved) if moved.count() <= MOST_SPLITS else moved, ["path", "block"]).select("path", (F.col("at") + F.col("moved")).alias("line"), "value")


def located(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """(path, line, row, broken) of ``lines`` (path, line, value) of JSON: the row by the schema, or the text of a line that is no object of it; blank lines are skipped."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = T.StructType([*fields.fields, T.StructField("_broken", T.StringType())])
    parsed = lines.where(F.trim("value") != "").select("path", "line", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("row"))
    return parsed.select("path", "line", F.struct(*[F.col("row")[f.name].alias(f.name) for f in fields]).alias("row"), F.col("row._broken").alias("broken"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, and a malformed line ends the query with an error that says its file and number."""
    found = located(numbered_lines(spark, path), schema)
    fault = F.raise_error(F.concat(F.lit("not a row: "), F.col("path"), F.lit(":"), F.col("line"), F.lit(": "), F.substring("broken", 1, 100)))
    return found.select(F.when(F.col("broken").isNotNull(), fault).otherwise(F.col("row")).alias("row")).select("row.*")


def read_episodes(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """One row an episode from (gzipped) JSON documents that each hold an array ``episodes``; ``scene`` is the file's name."""
    documents = spark.read.schema(T.StructType([T.StructField("episodes", T.ArrayType(schema))])).option("multiLine", True).json(path)
    scene = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return documents.select(scene.alias("scene"), F.explode("episodes").alias("e")).select("scene", "e.*")


def read_episode_set(spark: SparkSession, main: str, schema: T.StructType, scenes: list[str] | None = None) -> DataFrame:
    """The episodes of a main document and of those of its scenes, ``content/<scene>.json.gz`` beside it, as far as there are any; of some scenes if they are named."""
    folder = main.rpartition("/")[0]
    paths = [main, *(f"{folder}/content/{s}.json.gz" for s in (_names(spark, f"{folder}/content") if scenes is None else scenes))]
    return read_episodes(spark, paths, schema)


def _names(spark: SparkSession, folder: str) -> list[str]:
    """The scenes that a folder has documents of, sorted; none if it is missing. They are few enough for the driver."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    names = [f.getPath().getName() for f in store.listStatus(place)]
    return sorted({n.removesuffix(".gz").removesuffix(".json") for n in names if not n.startswith((".", "_"))})


def scenes_of(spark: SparkSession, path: str) -> DataFrame:
    """(scene): the scenes of a folder's files, by their names, sorted; none if the folder is missing."""
    return spark.createDataFrame([(n,) for n in _names(spark, path)], "scene string").orderBy("scene")


def tagged(lines: DataFrame, tag: str, names: list[str], line: str = "value") -> DataFrame:
    """Rows of record-typed text whose first token is ``tag``; the tokens after it by name, as strings."""
    tokens = F.split(F.trim(line), r"\s+")
    return lines.where(tokens[0] == tag).select(*[F.get(tokens, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def json_safe(value: Column) -> Column:
    """A double with NaN and the infinities as null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))

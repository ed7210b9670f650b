"""What operators that work in rounds share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a temporary one only where none is named and Spark runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="auralake-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once into the checkpoint folder; later plans start from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt (by columns) to tasks of some ``rows`` rows each: small files and small shuffles that grow in a task would else be few tasks, whatever they grow to."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)


def written(df: DataFrame) -> DataFrame:
    """Like ``kept``, as a table of files: for loops, in which Spark's estimates of a checkpoint's size would grow with each join that it comes from."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)

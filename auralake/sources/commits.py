"""Guarded outputs: an output folder is written once, checked, and then marked as final."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_component(name: str) -> str:
    """``name`` if it is a single path component that every store takes; ValueError otherwise."""
    if not name or name.endswith(".") or len(PurePosixPath(name).parts) != 1 or any(c in "/\\:" or ord(c) < 32 for c in name):
        raise ValueError(f"not a single path component: {name!r}")
    return name


class Output:
    """A folder of tables in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, dataset: str):
        self.spark, self.folder = spark, f"{root}/{safe_component(dataset)}"
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.folder}/{name}")
        self._store = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    @property
    def final(self) -> bool:
        return self._store.exists(self._path("_FINAL"))

    def write(self, name: str, rows: DataFrame, key: list[str]) -> None:
        """Writes ``rows`` as sorted JSON lines; ValueError if the key repeats or is null, PermissionError if the output is final."""
        if self.final:
            raise PermissionError(f"{self.folder} is final")
        missing = F.lit(False)
        for k in key:
            missing = missing | F.col(k).isNull()
        if not rows.groupBy(*key).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | missing).isEmpty():
            raise ValueError(f"{name}: key {key} repeats or is null")
        rows.select(*sorted(rows.columns)).repartitionByRange(*[F.col(k).cast("string") for k in key]).sortWithinPartitions(*[F.col(k).cast("string") for k in key]).write.mode("overwrite").json(f"{self.folder}/{safe_component(name)}")

    def append(self, log: str, rows: DataFrame, form: str = "json") -> None:
        """Adds ``rows`` to a log of this output, as JSON lines or as CSV whose files begin with a header; what is there stays as it is."""
        if self.final:
            raise PermissionError(f"{self.folder} is final")
        writer = rows.write.mode("append")
        (writer.option("header", True) if form == "csv" else writer).format(form).save(f"{self.folder}/{safe_component(log)}")

    def report(self, name: str, rows: DataFrame) -> dict:
        """Writes the one row of ``rows``, a report's aggregates, with the time in UTC as a JSON document, and returns it; ValueError unless it is one row."""
        if self.final:
            raise PermissionError(f"{self.folder} is final")
        found = rows.withColumn("generated_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).select(F.to_json(F.struct("*")).alias("j")).take(2)
        if len(found) != 1:
            raise ValueError(f"{name}: a report is one row")
        report = json.loads(found[0].j)
        self._put(f"{safe_component(name)}.json", json.dumps(report, sort_keys=True, indent=2) + "\n", True)
        return report

    def text(self, name: str, content: str) -> None:
        """Writes a short text, such as a summary in Markdown."""
        if self.final:
            raise PermissionError(f"{self.folder} is final")
        self._put(safe_component(name), content, True)

    def _put(self, name: str, content: str, over: bool) -> None:
        stream = self._store.create(self._path(name), over)
        stream.write(bytearray(content.encode()))
        stream.close()

    def bytes_by_kind(self) -> DataFrame:
        """(kind, files, bytes) of the files below the folder by their suffix, markers left out."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.folder).select("path", "length").where(~F.col("path").rlike(r"/_[^/]*$"))
        return files.groupBy(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

    def finish(self, report: dict) -> None:
        """Marks the output as final; ValueError unless the report's status is PASS."""
        if report.get("status") != "PASS":
            raise ValueError("only an output that passed its checks can be final")
        self._put("_FINAL", json.dumps(report, sort_keys=True), False)


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over`` laid on it, mappings key by key."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


#: What a configuration must say: key path -> test.
CONTRACT = {
    ("audio", "sample_rate_hz"): lambda v: v == 16000,
    ("audio", "segment_seconds"): lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v > 0,
    ("dataset_id",): lambda v: isinstance(v, str) and v == safe_component(v),
    ("seed",): lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0,
}


def violated(config: dict) -> list[str]:
    """The dotted keys of a configuration that are missing or break the contract."""
    found = []
    for path, test in CONTRACT.items():
        value = config
        try:
            for k in path:
                value = value[k]
            fine = test(value)
        except (KeyError, TypeError, ValueError):
            fine = False
        if not fine:
            found.append(".".join(path))
    return found


def evidence_status(evidence: dict | None, checks: int = 3) -> str:
    """UNKNOWN without evidence; ValueError if it is incomplete; else PASS or FAIL."""
    if not evidence:
        return "UNKNOWN"
    spots = evidence.get("spot_checks")
    if not isinstance(spots, list) or len(spots) != checks:
        raise ValueError(f"evidence needs exactly {checks} spot checks")
    return "PASS" if all(s.get("passed") is True for s in spots) else "FAIL"

"""The library's queries by name: what builds each, the operators it covers, and its SQL if it has any."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    covers: str
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(build: Builder) -> Builder:
        QUERIES[build.__name__] = Query(build, covers, sql)
        return build

    return add

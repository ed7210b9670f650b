"""Columns of any depth: values rewritten by a walk of their type, and scalars of open records by dotted names."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rounds import kept
from ..sources.tables import json_safe

Leaf = Callable[[Column, T.DataType], Column]


def rewritten(value: Column, kind: T.DataType, leaf: Leaf) -> Column:
    """``value`` of the type ``kind`` with ``leaf`` applied to what is no array, struct or map; null containers stay null."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rewritten(x, kind.elementType, leaf))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: rewritten(x, kind.valueType, leaf))
    if isinstance(kind, T.StructType):
        made = F.struct(*[rewritten(value.getField(f.name), f.dataType, leaf).alias(f.name) for f in kind])
        return F.when(value.isNotNull(), made)
    return leaf(value, kind)


def finite(rows: DataFrame) -> DataFrame:
    """``rows`` with NaN and the infinities as null in all columns, at any depth."""
    real = (T.DoubleType, T.FloatType)
    return rows.select(*[rewritten(F.col(f"`{f.name}`"), f.dataType, lambda x, k: json_safe(x) if isinstance(k, real) else x).alias(f.name) for f in rows.schema])


def leaves(kind: T.StructType, without: Collection[str] = (), above: str = "") -> list[str]:
    """Dotted names of the fields of a struct type that hold no further fields; those named in ``without``, in full or at their level, are left out with all below."""
    found = []
    for f in kind:
        name = f"{above}{f.name}"
        if f.name not in without and name not in without:
            found += leaves(f.dataType, without, f"{name}.") if isinstance(f.dataType, T.StructType) else [name]
    return found


def flattened(rows: DataFrame, without: Collection[str] = ()) -> DataFrame:
    """``rows`` with a column for each leaf of its structs, by dotted name."""
    return rows.select(*[F.col(".".join(f"`{p}`" for p in name.split("."))).alias(name) for name in leaves(rows.schema, without)])


def scalars(rows: DataFrame, keys: list[str], info: str, without: Collection[str] = ()) -> DataFrame:
    """(keys, name, value): the numbers and truth values of a VARIANT column by dotted name, whatever fields its records have.

    A round opens the records of one level and ends when none is left. Names in ``without``, in full or at their level, are left out
    with all below; texts, lists and nulls are left out.
    """
    level = kept(rows.select(*keys, F.lit("").alias("name"), F.col(info).alias("value")).where("value is not null"))
    found = None
    while True:
        fields = level.where(F.schema_of_variant("value").startswith("OBJECT")).select(*keys, "name", F.explode(F.col("value").cast("map<string,variant>")).alias("key", "value"))
        named = fields.select(*keys, "key", F.concat("name", "key").alias("name"), "value").where(~F.col("key").isin(list(without)) & ~F.col("name").isin(list(without)) & F.col("value").isNotNull())
        level = kept(named.select(*keys, F.concat("name", F.lit(".")).alias("name"), "value").where(F.schema_of_variant("value").startswith("OBJECT")))
        number = F.schema_of_variant("value").rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
        own = named.where(number).select(*keys, "name", F.coalesce(F.try_variant_get("value", "$", "double"), F.try_variant_get("value", "$", "boolean").cast("double")).alias("value"))
        found = own if found is None else found.unionByName(own)
        if level.isEmpty():
            return found

"""Maps as tables of cells (keys, x, y): only cells that are set are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _spread(cells: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Each cell and the eight around it, inside the map."""
    around = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in _AROUND])
    moved = cells.select(*keys, "x", "y", F.inline(around)).select(*keys, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    return moved.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def closed(cells: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Morphological closing with a square of three cells; what lies outside the map has no say."""
    wide = _spread(cells, keys, width, height).distinct()
    at_edge = lambda c, size: F.when(F.col(c).isin(0, size - 1), 2).otherwise(3)
    counted = _spread(wide, keys, width, height).groupBy(*keys, "x", "y").agg(F.count("*").alias("_n"))
    return counted.where(F.col("_n") == at_edge("x", width) * at_edge("y", height)).select(*keys, "x", "y")


def lattice(scenes: DataFrame, keys: list[str], width: int, height: int, stride: int) -> DataFrame:
    """Steps (keys, x, y, dx, dy) between neighbouring lattice points, to the right and upwards."""
    points = lambda size: F.sequence(F.lit(0), F.lit(size - 1), F.lit(stride))
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((stride, 0), (0, stride))])
    nodes = scenes.select(*keys).distinct().withColumn("x", F.explode(points(width))).withColumn("y", F.explode(points(height)))
    return nodes.select(*keys, "x", "y", F.inline(steps)).where((F.col("x") + F.col("dx") < width) & (F.col("y") + F.col("dy") < height))


def blocked(steps: DataFrame, obstacles: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """``steps`` with ``blocked``: whether an obstacle lies on the way, both ends included.

    An obstacle on a line of the lattice names the steps that it lies on, two of them at a lattice
    point, so they meet in an equi-join.
    """
    def on(along: str, across: str) -> DataFrame:
        here = F.floor(F.col(along) / stride) * stride
        starts = F.when(F.pmod(F.col(along), F.lit(stride)) == 0, F.array(here, here - stride)).otherwise(F.array(here))
        found = obstacles.where(F.pmod(F.col(across), F.lit(stride)) == 0).select(*keys, across, F.explode(starts).alias(along))
        return found.select(*keys, "x", "y", F.lit(stride if along == "x" else 0).alias("dx"), F.lit(stride if along == "y" else 0).alias("dy"))

    hit = on("x", "y").unionByName(on("y", "x")).distinct().withColumn("_hit", F.lit(True))
    return steps.join(hit, [*keys, "x", "y", "dx", "dy"], "left").withColumn("blocked", F.coalesce("_hit", F.lit(False))).drop("_hit")


def turned(x: Column, y: Column, rotation: Column, width: int, height: int) -> tuple[Column, Column]:
    """Where a cell of a map comes to lie when the map is turned counterclockwise by quarter turns."""
    turn = F.pmod(rotation, F.lit(360))
    pick = lambda a, b, c, d: F.when(turn == 0, a).when(turn == 90, b).when(turn == 180, c).otherwise(d)
    return pick(x, y, width - 1 - x, height - 1 - y), pick(y, width - 1 - x, height - 1 - y, x)


def to_ego(x: Column, y: Column, rotation: Column) -> tuple[Column, Column]:
    """An offset on the map as seen by an agent that the map is turned for by ``rotation``."""
    turn = F.pmod(rotation, F.lit(360))
    pick = lambda a, b, c, d: F.when(turn == 0, a).when(turn == 90, b).when(turn == 180, c).otherwise(d)
    return pick(x, -y, -x, y), pick(y, x, -y, -x)


def from_ego(x: Column, y: Column, rotation: Column) -> tuple[Column, Column]:
    """The inverse of ``to_ego``."""
    return to_ego(x, y, -rotation)


def merged(observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, seen, blocked): one map of each key from what was seen of its cells, ``observed`` (keys, x, y, step, obstacle).

    ``seen`` is the first step at which a cell was seen, ``blocked`` the first at which it was seen as an obstacle, null if never;
    so the map as it was at any step is those rows that have lesser ones.
    """
    return observed.groupBy(*keys, "x", "y").agg(F.min("step").alias("seen"), F.min(F.when(F.col("obstacle"), F.col("step"))).alias("blocked"))

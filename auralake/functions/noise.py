"""Random numbers as column expressions: each is told by a seed and by where it is used, not by when or in which task."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *places: Column) -> Column:
    """A number between 0 and 1, both left out, for a seed and the values of ``places``: 48 bits of their SHA-256."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in places])
    return (F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(seed: int, *places: Column) -> Column:
    """A standard normal number for a seed and the values of ``places``, of two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(seed, *places, F.lit("r")))) * F.cos(2 * math.pi * uniform(seed, *places, F.lit("a")))


def jittered(values: Column, sigma: float, seed: int, *places: Column) -> Column:
    """An array of shares with normal noise at each second place, the first one left as it is, held between 0 and 1."""
    return F.transform(values, lambda x, i: F.when(i % 2 == 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x + sigma * normal(seed, *places, i)))).otherwise(x))

"""Distribution summaries of finite values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import finite
from .rounds import kept

SHARES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
#: Of sketches: a rank is known to one in so many.
LEAST_ACCURACY = 10_000
#: Groups up to which their sketches are sent to all tasks.
MOST_GROUPS = 100_000


def summarize(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, min, percentiles and max of the finite values; a group without any has count 0 and nulls.

    A sketch of each large group tells two values between which a percentile's ranks lie, of n values some
    ``6 * sqrt(n)`` ranks apart. A second reading counts what lies below, and the different values between, from which
    the exact ones at the ranks are taken. So no values are put in order but those, and the values of groups that are no
    larger than a sketch, which are held as counts.
    """
    given = rows.where(finite(F.col(value))).select(*by, F.col(value).cast("double").alias("_x"))
    accuracy = max(LEAST_ACCURACY, min(1_000_000, int(given.count() ** 0.5)))
    slack, shares = 3 / accuracy, list(SHARES.values())
    points = [*(max(0.0, s - slack) for s in shares), *(min(1.0, s + slack) for s in shares)]
    size = kept(given.groupBy(*by).agg(F.count("*").alias("count"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.percentile_approx("_x", points, accuracy).alias("_p")))
    few = size.select(*by, "_p", "count")
    told = given.join(F.broadcast(few) if size.count() <= MOST_GROUPS else few, by)
    small = told.where(F.col("count") < accuracy).groupBy(*by).agg(F.percentile("_x", F.array(*map(F.lit, shares))).alias("_q")).select(*by, *[F.col("_q")[k].alias(name) for k, name in enumerate(SHARES)])
    near = told.where(F.col("count") >= accuracy)
    # Of a percentile: null for a value below the two, the value itself between them.
    between = F.array(*[F.when(F.col("_x") <= F.col("_p")[k + len(shares)], F.struct(F.lit(k).alias("_k"), F.when(F.col("_x") >= F.col("_p")[k], F.col("_x")).alias("_v"))) for k in range(len(shares))])
    counted = near.select(*by, F.inline(F.array_compact(between))).groupBy(*by, "_k", "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_k").orderBy(F.col("_v").asc_nulls_first()))
    place = F.element_at(F.array(*map(F.lit, shares)), F.col("_k") + 1) * (F.col("count") - 1)
    ranked = counted.withColumn("_upto", upto).join(size.select(*by, "count"), by).withColumn("_low", F.floor(place))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.struct("_upto", "_v")))
    found = ranked.groupBy(*by, "_k").agg(at(F.col("_low")).alias("_a"), at(F.least(F.col("_low") + 1, F.col("count") - 1)).alias("_b"), F.max(place - F.col("_low")).alias("_part"))
    exact = F.when(F.col("_a._v").isNull() | F.col("_b._v").isNull(), F.raise_error(F.lit("a percentile lies outside its sketch's bounds"))).otherwise(F.col("_a._v") + F.col("_part") * (F.col("_b._v") - F.col("_a._v")))
    wide = found.select(*by, "_k", exact.alias("_q")).groupBy(*by).agg(*[F.max(F.when(F.col("_k") == k, F.col("_q"))).alias(name) for k, name in enumerate(SHARES)])
    joined = rows.select(*by).distinct().join(size.drop("_p"), by, "left").join(wide.unionByName(small), by, "left")
    return joined.select(*by, F.coalesce("count", F.lit(0)).alias("count"), "min", *SHARES, "max")


def rate(condition: Column) -> Column:
    """The share of rows for which a condition holds, 0 without rows."""
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))

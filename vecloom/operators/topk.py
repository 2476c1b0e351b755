"""Top-k by absolute value.

The k-th magnitude comes first: a task hands on k rows (of each group) at most. The elements that reach it are then a filter,
so any number of ties stays where it is and never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.scalars import magnitude


def _size(x: DataFrame) -> Column:
    return magnitude(F.col("v"), x.select("v").schema[0].dataType.simpleString())


def _checked(k: int) -> int:
    if k <= 0:
        raise ValueError("k must be positive")
    return k


def k_largest_abs(x: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(i, v), with ``by`` also that column: all elements (of a group) with |v| at least the k-th largest; ties come too.

    NaN counts as larger than infinity. k over the number of elements gives all; a null has no magnitude and is left out.
    """
    least = threshold_abs(x, k, by)
    if by is None:
        return x.filter(_size(x) >= least.scalar()).select("i", "v")
    least = least.select(F.col(by).alias("_by"), F.col("threshold").alias("_t"))
    return x.join(least, F.col(by).eqNullSafe(F.col("_by"))).filter(_size(x) >= F.col("_t")).select(by, "i", "v")


def k_largest_abs_strict(x: DataFrame, k: int) -> DataFrame:
    """(i, v): exactly k elements, ties by the smaller index."""
    return x.withColumn("_a", _size(x)).orderBy(F.col("_a").desc(), "i").limit(_checked(k)).select("i", "v")


def threshold_abs(x: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """The k-th largest |v| (the least, if there are fewer): (threshold), or (group, threshold) with ``by``."""
    if by is None:
        return x.select(_size(x).alias("_a")).orderBy(F.col("_a").desc()).limit(_checked(k)).agg(F.min("_a").alias("threshold"))
    # row_number, not rank: Spark keeps k rows a group before the shuffle, however many tie.
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("_a").desc()))
    top = x.select(by, _size(x).alias("_a")).withColumn("_r", place).filter(F.col("_r") <= _checked(k))
    return top.groupBy(by).agg(F.min("_a").alias("threshold"))

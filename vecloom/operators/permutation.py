"""Permutations ``(i, p)`` and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.plans.running import BUCKET, running


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """b^-1[a[i]]: where b puts what a puts at i."""
    return a.select("i", F.col("p").alias("x")).join(b.select(F.col("i").alias("p"), F.col("p").alias("y")), F.col("x") == F.col("y")).select("i", "p")


def multiply_successive(stack: DataFrame) -> DataFrame:
    """``stack(j, i, p)`` of N permutations to N-1 products of neighbours, in one join."""
    left = stack.select("j", "i", F.col("p").alias("x"))
    right = stack.select((F.col("j") - 1).alias("k"), F.col("i").alias("p"), F.col("p").alias("y"))
    return left.join(right, (F.col("j") == F.col("k")) & (F.col("x") == F.col("y"))).select("j", "i", "p")


def swaps(flags: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(i, p) of length n + 1 for n ``flags(i, f)`` of any number: :func:`from_swaps` as a running maximum in buckets."""
    held = F.when(~F.col("f"), F.col("i") + 1).otherwise(F.lit(0).cast("long"))
    end = flags.agg((F.coalesce(F.max("i"), F.lit(-1)) + 1).cast("long").alias("i"), F.lit(False).alias("f"))
    rows = running(flags.select(F.col("i").cast("long").alias("i"), "f").unionByName(end), held, "max", "_last", bucket=bucket, exclusive=True)
    return rows.select("i", F.when(F.col("f"), F.col("i") + 1).otherwise(F.coalesce("_last", F.lit(0).cast("long"))).alias("p"))


def from_swaps(flags: Column) -> Column:
    """The permutation that swaps neighbours j, j+1 for each true flag in turn, as an array; flags are an array of booleans.

    An element that a swap moves down takes the next one's place; the one carried up stops behind the first false flag.
    """
    n = F.size(flags)
    at = F.sequence(F.lit(0), n)
    last_false = lambda i: F.coalesce(F.array_max(F.filter(F.transform(F.slice(flags, 1, i), lambda f, k: F.when(~f, k + 1)), lambda k: k.isNotNull())), F.lit(0))
    return F.transform(at, lambda i: F.when((i < n) & F.try_element_at(flags, i + 1), i + 1).otherwise(last_false(i)))

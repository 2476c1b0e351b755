"""Vectors ``(i, v)`` from ranges, constants, random numbers and Python values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def iota(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    """v = start + i."""
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") + F.lit(start)).alias("v"))


def fill(vector: DataFrame, value) -> DataFrame:
    return vector.select("i", F.lit(value).alias("v"))


def _drawn(spark: SparkSession, n: int, value: Column) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), value.alias("v"))


def generate(spark: SparkSession, n: int, quantile, seed: int = 0) -> DataFrame:
    """v drawn from any distribution, given its quantile function as Column -> Column."""
    return _drawn(spark, n, quantile(F.rand(seed)))


def uniform_real(spark: SparkSession, n: int, low: float, high: float, seed: int = 0) -> DataFrame:
    if low > high:
        raise ValueError("low must not exceed high")
    return _drawn(spark, n, F.rand(seed) * F.lit(high - low) + F.lit(low))


def normal_real(spark: SparkSession, n: int, mean: float, deviation: float, seed: int = 0) -> DataFrame:
    if deviation < 0:
        raise ValueError("the deviation must not be negative")
    return _drawn(spark, n, F.randn(seed) * F.lit(deviation) + F.lit(mean))


def _complex(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def uniform_complex(spark: SparkSession, n: int, low: float, high: float, seed: int = 0) -> DataFrame:
    if low > high:
        raise ValueError("low must not exceed high")
    draw = lambda s: F.rand(s) * F.lit(high - low) + F.lit(low)
    return _drawn(spark, n, _complex(draw(seed), draw(seed + 1)))


def normal_complex(spark: SparkSession, n: int, mean: float, deviation: float, seed: int = 0) -> DataFrame:
    if deviation < 0:
        raise ValueError("the deviation must not be negative")
    draw = lambda s: F.randn(s) * F.lit(deviation) + F.lit(mean)
    return _drawn(spark, n, _complex(draw(seed), draw(seed + 1)))


def from_values(spark: SparkSession, values: Sequence, kind: str = "double") -> DataFrame:
    """A vector from driver-side values."""
    return spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")

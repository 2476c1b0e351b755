"""Element-wise operators on indexed vectors ``(i, v)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transform(x: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return x.select("i", f(F.col("v")).alias("v"))


def copy(x: DataFrame, kind: str | None = None) -> DataFrame:
    """Copy with conversion to another element type."""
    return x.select("i", F.col("v").cast(kind).alias("v")) if kind else x.select("i", "v")


def paired(x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, x, y) by index; an index that one side lacks is an error, as vectors must have one length."""
    both = x.select("i", F.col("v").alias("x"), F.lit(True).alias("in_x")).join(y.select("i", F.col("v").alias("y"), F.lit(True).alias("in_y")), "i", "full")
    whole = F.col("in_x").isNotNull() & F.col("in_y").isNotNull()
    checked = F.when(whole, F.col("i")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("long"))
    return both.select(checked.alias("i"), "x", "y")


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """a * x + y."""
    return paired(x, y).select("i", (F.lit(a) * F.col("x") + F.col("y")).alias("v"))


def axmy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """a * x * y."""
    return paired(x, y).select("i", (F.lit(a) * F.col("x") * F.col("y")).alias("v"))


def equal(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row (equal): all elements agree; null and NaN agree with themselves. Different lengths are not equal."""
    both = x.select("i", F.col("v").alias("x"), F.lit(1).alias("a")).join(y.select("i", F.col("v").alias("y"), F.lit(1).alias("b")), "i", "full")
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("x").eqNullSafe(F.col("y"))
    return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))


def multi(vectors: dict[str, DataFrame], offsets: dict[str, int] | None = None) -> DataFrame:
    """N vectors side by side, (i, name, ...). With ``offsets`` a vector is read at i + offset, which must exist."""
    out = None
    for name, x in vectors.items():
        x = x.select((F.col("i") - F.lit((offsets or {}).get(name, 0))).cast(x.schema["i"].dataType).alias("i"), F.col("v").alias(name))
        out = x if out is None else out.join(x, "i")
    return out

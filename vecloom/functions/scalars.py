"""Scalar, bit and text functions as Column expressions."""

from __future__ import annotations

import socket

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def ceil_divide(a: Column, b: Column) -> Column:
    """Integer quotient rounded away from zero; 0 over anything is 0."""
    a, b = a.cast("long"), b.cast("long")
    size = F.try_divide(F.abs(a) + F.abs(b) - 1 - F.pmod(F.abs(a) + F.abs(b) - 1, F.when(b == 0, 1).otherwise(F.abs(b))), F.abs(b)).cast("long")
    return F.when(a == 0, F.lit(0).cast("long")).when(b == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise(F.signum(a).cast("long") * F.signum(b).cast("long") * size)


def sincos(x: Column) -> Column:
    return F.struct(F.sin(x).alias("sin"), F.cos(x).alias("cos"))


def count_leading_zeros(x: Column, width: int = 64) -> Column:
    """Zero bits above the highest one of a ``width`` bit integer; the width if there is none."""
    if width not in (32, 64):
        raise ValueError("width is 32 or 64")
    bits = x.cast("long")
    if width == 32:
        bits = bits.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(bits == 0, width).otherwise(width - F.length(F.bin(bits))).cast("int")


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| / |b|; null where b is 0."""
    return F.try_divide(F.abs(a - b), F.abs(b))


def tuple_to_string(*members: Column) -> Column:
    """Comma-joined; a whole number is written without a fraction."""

    def text(m: Column) -> Column:
        return F.regexp_replace(m.cast("string"), r"\.0$", "")

    return F.concat_ws(",", *map(text, members))


def hostname() -> str:
    """Name of the driver's machine."""
    return socket.gethostname()


def magnitude(v: Column, kind: str) -> Column:
    """|v| as a value that exists for every input: integers are widened first, so the least one has a magnitude."""
    return F.abs(v.cast("long")) if kind in ("tinyint", "smallint", "int") else F.abs(v.cast("decimal(20,0)")) if kind == "bigint" else F.abs(v)


@F.pandas_udf(LongType())
def float_bits(v: pd.Series) -> pd.Series:
    """The 32 bits of a float as a non-negative long. Arrow batches; Spark has no expression for it."""
    return pd.Series(v.to_numpy(np.float32).view(np.uint32).astype(np.int64))


@F.pandas_udf(LongType())
def double_bits(v: pd.Series) -> pd.Series:
    """The 64 bits of a double as a long."""
    return pd.Series(v.to_numpy(np.float64).view(np.int64))

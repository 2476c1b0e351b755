"""Batched and segmented sorts: the sorted place is data, one partitioned window per sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.reduction import by_pointers


def _batched(x: DataFrame, size: int, order: list[Column]) -> DataFrame:
    if size < 1:
        raise ValueError("the batch size must be positive")
    batch = F.floor(F.col("i") / F.lit(size)).cast("long")
    place = F.row_number().over(Window.partitionBy("_batch").orderBy(*order))
    return x.withColumn("_batch", batch).withColumn("pos", F.col("_batch") * size + place - 1).drop("_batch")


def batched_descending(x: DataFrame, size: int) -> DataFrame:
    """Add ``pos``: order of ``k`` from large to small inside each run of ``size`` indices, stable."""
    return _batched(x, size, [F.col("k").desc(), F.col("i")])


def batched_abs(x: DataFrame, size: int) -> DataFrame:
    """Add ``pos``: order of |k| from small to large inside each batch, stable; signs stay."""
    return _batched(x, size, [F.abs("k"), F.col("i")])


def segmented(x: DataFrame) -> DataFrame:
    """Add ``pos``: the place inside the segment ``seg`` in order of ``k``, stable."""
    return x.withColumn("pos", (F.row_number().over(Window.partitionBy("seg").orderBy("k", "i")) - 1).cast("long"))


def segmented_by_pointers(x: DataFrame, ptrs: DataFrame) -> DataFrame:
    """As :func:`segmented`, for segments that ascending ``ptrs(line, ptr)`` cut; adds ``seg``, and ``pos`` counts through all."""
    ends = ptrs.select((F.col("line") - 1).alias("line"), F.col("ptr").alias("hi"))
    segs = ptrs.join(ends, "line").select(F.col("line").alias("seg"), F.col("ptr").alias("lo"), "hi")
    own = segmented(by_pointers(x, segs)).join(segs.select(F.col("seg").alias("_s"), F.col("lo").alias("_lo")), F.col("seg") == F.col("_s"))
    return own.withColumn("pos", F.col("pos") + F.col("_lo")).drop("_s", "_lo")


def by_magnitude(x: DataFrame, descending: bool = False) -> DataFrame:
    """Rows in order of |v|: a range-partitioned global sort."""
    a = F.abs("v")
    return x.orderBy(a.desc() if descending else a.asc(), "i")

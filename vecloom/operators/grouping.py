"""Packing neighbouring subgroups into groups of about equal work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.plans.running import BUCKET, positions, running


def wrap_subgroups(ptrs: DataFrame, mean: int, bucket: int = BUCKET) -> DataFrame:
    """(group, ptr): group g takes the subgroups ptr[g] .. ptr[g+1]-1, about ``mean`` elements, from ``ptrs(i, ptr)``.

    A boundary is set behind the subgroup whose end crosses a multiple of ``mean``; none is split and the last group takes
    what is left. No subgroup: no rows. Pointers ascend, so the slot before is a running maximum in buckets.
    """
    if mean < 1:
        raise ValueError("mean must be positive")
    rows = ptrs.select("i", "ptr", F.floor(F.col("ptr") / F.lit(mean)).cast("long").alias("cur"))
    rows = running(rows, F.col("cur"), "max", "prev", bucket=bucket, exclusive=True)
    ends = ptrs.agg(F.struct(F.max("i").alias("last"), F.max("ptr").alias("total")).alias("e")).scalar()
    last, total = ends["last"], ends["total"]
    n = F.greatest(F.floor(total / F.lit(mean)).cast("long") + 1, F.lit(2).cast("long")) - 1
    inner = (F.col("cur") != F.col("prev")) & (F.col("cur") != 0) & (F.col("cur") != n)
    kept = rows.filter((last > 0) & ((F.col("i") == 0) | (F.col("i") == last) | inner)).select("i")
    return positions(kept, "group", bucket=bucket).select("group", F.col("i").alias("ptr"))

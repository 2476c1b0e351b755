"""Two-level plans for what would otherwise be a window over the whole table in one task.

Rows are bucketed by ``i div BUCKET``. A bucket's total is a partial aggregate; the running total over buckets is a window
over one row per bucket (some millions for 10^13 rows); inside a bucket a partitioned window does the rest. Buckets are a function of the index, so a
recomputed task gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 20
#: Aggregate and combining function of each operation.
OPERATIONS = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "product": (F.product, lambda a, b: a * b),
}


def running(df: DataFrame, value: Column, op: str, out: str, index: str = "i", bucket: int = BUCKET, exclusive: bool = False) -> DataFrame:
    """Add ``out``: the inclusive (or exclusive; null at the start) running ``op`` of ``value`` in order of ``index``."""
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {op!r}")
    fold, join = OPERATIONS[op]
    rows = df.withColumn("_b", F.floor(F.col(index) / F.lit(bucket)).cast("long")).withColumn("_v", value)
    totals = rows.groupBy("_b").agg(fold("_v").alias("_t"))
    before = totals.select(F.col("_b").alias("_c"), fold("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    last = -1 if exclusive else 0
    local = rows.withColumn("_own", fold("_v").over(Window.partitionBy("_b").orderBy(index).rowsBetween(Window.unboundedPreceding, last)))
    both = local.join(before, F.col("_b") == F.col("_c"))
    whole = F.when(F.col("_before").isNull(), F.col("_own")).when(F.col("_own").isNull(), F.col("_before")).otherwise(join(F.col("_before"), F.col("_own")))
    return both.withColumn(out, whole).drop("_b", "_c", "_v", "_own", "_before")


def positions(df: DataFrame, out: str = "pos", index: str = "i", bucket: int = BUCKET) -> DataFrame:
    """Add ``out``: the 0-based place of a row in order of ``index`` (unique)."""
    return running(df, F.lit(1).cast("long"), "sum", "_n", index, bucket).withColumn(out, F.col("_n") - 1).drop("_n")

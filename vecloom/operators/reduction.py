"""Folds of a whole vector, of segments and of columns, and running folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.plans.running import BUCKET, OPERATIONS, running

Operation = str | Callable[[Column, Column], Column]
#: A function of the user is folded over arrays of this many elements, level by level.
FOLD, LEVELS = 256, 4


def tree_fold(x: DataFrame, f: Callable[[Column, Column], Column], by: tuple[str, ...] = (), width: int = FOLD, levels: int = LEVELS) -> DataFrame:
    """(by..., v): fold of ``v`` in order of ``i`` with an associative ``f``, null for no element (without ``by``).

    Each level folds runs of ``width`` neighbours and keeps their order, so ``f`` need not commute; the last level takes
    what is left, about n / width ** (levels - 1) elements of a group.
    """
    kind = x.schema["v"].dataType.simpleString()
    rows = x.select(*by, F.col("i").cast("long").alias("i"), "v")
    for level in range(levels):
        keys = [*by, *([F.floor(F.col("i") / F.lit(width)).cast("long").alias("i")] if level < levels - 1 else [])]
        runs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))
        first, rest = F.get("m", F.lit(0))["v"], F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0)))
        rows = runs.select(*by, *(["i"] if level < levels - 1 else []), F.aggregate(rest, first, lambda a, s: f(a, s["v"]).cast(kind)).alias("v"))
    return rows


def tree_scan(x: DataFrame, f: Callable[[Column, Column], Column], width: int = FOLD, levels: int = LEVELS) -> DataFrame:
    """(i, v, before): inclusive and exclusive running fold with an associative ``f``; ``before`` is null at the start."""
    kind = x.schema["v"].dataType.simpleString()
    step = f"array<struct<i:bigint,v:{kind},before:{kind}>>"
    key = F.floor(F.col("i") / F.lit(width)).cast("long") if levels > 1 else F.lit(0).cast("long")
    runs = x.groupBy(key.alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "v"))).alias("m"))

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)["v"]
        return F.array_append(out, F.struct(s["i"].alias("i"), f(last, s["v"]).cast(kind).alias("v"), last.alias("before"))).cast(step)

    first = F.get("m", F.lit(0))
    start = F.array(F.struct(first["i"].alias("i"), first["v"].alias("v"), F.lit(None).cast(kind).alias("before"))).cast(step)
    runs = runs.select("k", F.aggregate(F.slice("m", 2, F.size("m") - 1), start, add).alias("out"))
    local = runs.select("k", F.explode("out").alias("e")).select("k", "e.*")
    if levels == 1:
        return local.select("i", "v", "before")
    totals = tree_scan(runs.select(F.col("k").alias("i"), F.element_at("out", -1)["v"].alias("v")), f, width, levels - 1)
    both = local.join(totals.select(F.col("i").alias("_k"), F.col("before").alias("_b")), F.col("k") == F.col("_k"))
    joined = lambda c: F.when(F.col("_b").isNull(), F.col(c)).when(F.col(c).isNull(), F.col("_b")).otherwise(f(F.col("_b"), F.col(c)).cast(kind)).alias(c)
    return both.select("i", joined("v"), joined("before"))


def reduce(x: DataFrame, op: Operation, init) -> DataFrame:
    """One row (v): init op v0 op v1 ...; init if there is no element. ``op``: a name of OPERATIONS or an associative function."""
    if callable(op):
        return tree_fold(x, op).select(F.when(F.col("v").isNull(), F.lit(init)).otherwise(op(F.lit(init), F.col("v"))).alias("v"))
    fold, join = OPERATIONS[op]
    return x.agg(fold("v").alias("t")).select(F.when(F.col("t").isNull(), F.lit(init)).otherwise(join(F.lit(init), F.col("t"))).alias("v"))


def fold_ordered(x: DataFrame, f: Callable[[Column, Column], Column], init: Column, by: str) -> DataFrame:
    """(by, v): fold in index order with any function, one group in one task: for groups of bounded size."""
    rows = x.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))
    return rows.select(by, F.aggregate("m", init, lambda a, s: f(a, s["v"])).alias("v"))


def segmented_reduce(x: DataFrame, segments: DataFrame, op: Operation, init) -> DataFrame:
    """(seg, v) for every row of ``segments(seg)``; ``x`` carries its segment in ``seg``. An empty segment gives init."""
    if callable(op):
        done, join = tree_fold(x, op, ("seg",)).withColumnRenamed("v", "t"), op
    else:
        fold, join = OPERATIONS[op]
        done = x.groupBy("seg").agg(fold("v").alias("t"))
    return segments.select("seg").join(done, "seg", "left").select("seg", F.when(F.col("t").isNull(), F.lit(init)).otherwise(join(F.lit(init), F.col("t"))).alias("v"))


def by_pointers(x: DataFrame, segments: DataFrame, width: int = 1 << 12) -> DataFrame:
    """Add ``seg`` from ``segments(seg, lo, hi)``, lo <= i < hi: an equi-join on blocks of indices, then the exact test."""
    spread = segments.filter("hi > lo").withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    rows = x.withColumn("_b", F.floor(F.col("i") / width))
    return rows.join(spread, "_b").filter("lo <= i AND i < hi").drop("_b", "lo", "hi")


def sum_columns(x: DataFrame, n: int) -> DataFrame:
    """(i, v): column sums of a row-major array with n columns."""
    if n < 1:
        raise ValueError("n must be positive")
    return x.groupBy(F.pmod(F.col("i"), F.lit(n)).alias("i")).agg(F.sum("v").alias("v"))


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def finite_stats(x: DataFrame) -> DataFrame:
    """One row (finite, fraction); the fraction of no elements is null."""
    return x.agg(F.count_if(finite(F.col("v"))).alias("finite"), F.avg(finite(F.col("v")).cast("double")).alias("fraction"))


def inclusive_scan(x: DataFrame, op: Operation, bucket: int = BUCKET) -> DataFrame:
    """(i, v): v0 op ... op vi; ``op`` as in :func:`reduce`."""
    if callable(op):
        return tree_scan(x, op).select("i", "v")
    return running(x.select("i", "v"), F.col("v"), op, "s", bucket=bucket).select("i", F.col("s").alias("v"))

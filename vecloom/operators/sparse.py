"""Coordinate matrices ``(row, col, val)`` with their shape and storage order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.plans.running import running

ORDERS = ("row_major", "col_major", "none")


@dataclass(frozen=True)
class SparseTable:
    """A lazy matrix. ``order`` says how positions are numbered; duplicates of a coordinate are allowed."""

    df: DataFrame
    num_rows: int
    num_cols: int
    order: str = "none"

    def __post_init__(self):
        if self.order not in ORDERS or self.num_rows < 0 or self.num_cols < 0:
            raise ValueError("bad shape or storage order")
        if [c for c in ("row", "col", "val") if c not in self.df.columns]:
            raise ValueError("needs the columns row, col, val")

    def with_order(self, order: str) -> "SparseTable":
        """Another order; nothing moves until positions are asked for."""
        return replace(self, order=order if order != "none" else self.order)

    def positions(self) -> DataFrame:
        """(pos, row, col, val) numbered in storage order: lines are counted, then numbered inside."""
        if self.order == "none":
            raise ValueError("the matrix has no storage order")
        a, b = ("row", "col") if self.order == "row_major" else ("col", "row")
        starts = pointers(self, a).select(F.col("line").alias("_l"), F.col("ptr").alias("_p"))
        local = F.row_number().over(Window.partitionBy(a).orderBy(b, "val")) - 1
        rows = self.df.withColumn("_n", local)
        return rows.join(starts, F.col(a) == F.col("_l")).select((F.col("_p") + F.col("_n")).alias("pos"), "row", "col", "val")

    def transpose(self) -> "SparseTable":
        turned = {"row_major": "col_major", "col_major": "row_major", "none": "none"}[self.order]
        return SparseTable(self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), self.num_cols, self.num_rows, turned)

    def square(self) -> None:
        if self.num_rows != self.num_cols:
            raise ValueError("the matrix must be square")


def lines(m: SparseTable, axis: str) -> DataFrame:
    n = m.num_rows if axis == "row" else m.num_cols
    return m.df.sparkSession.range(n).select(F.col("id").alias("line"))


def pointers(m: SparseTable, axis: str = "row") -> DataFrame:
    """(line, ptr): n+1 start offsets of the rows (or cols), also for an empty matrix."""
    n = m.num_rows if axis == "row" else m.num_cols
    counts = m.df.groupBy(F.col(axis).alias("line")).agg(F.count("*").alias("n"))
    every = m.df.sparkSession.range(n + 1).select(F.col("id").alias("line")).join(counts, "line", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return running(every, F.col("n"), "sum", "ptr", "line", exclusive=True).select("line", F.coalesce("ptr", F.lit(0)).cast("long").alias("ptr"))


def pointers_to_indices(ptrs: DataFrame) -> DataFrame:
    """(i, line): the line of every element, from ``ptrs(line, ptr)``. Lines are cut by blocks, so a window is over few rows."""
    ends = ptrs.select((F.col("line") - 1).alias("line"), F.col("ptr").alias("hi"))
    spans = ptrs.join(ends, "line").filter(F.col("hi") > F.col("ptr"))
    return spans.select(F.explode(F.sequence("ptr", F.col("hi") - 1)).alias("i"), "line")


def max_row_entries(m: SparseTable) -> DataFrame:
    return m.df.groupBy("row").count().agg(F.coalesce(F.max("count"), F.lit(0)).cast("long").alias("n"))


def coordinates_unique(m: SparseTable) -> DataFrame:
    return m.df.groupBy("row", "col").count().agg((F.coalesce(F.max("count"), F.lit(0)) <= 1).alias("is_unique"))


def diagmm(diag: DataFrame, m: SparseTable) -> SparseTable:
    """diag(d) * A for a square A and ``diag(i, v)``; coordinates stay. The join's sides are Spark's choice by size."""
    m.square()
    d = diag.select(F.col("i").alias("_i"), F.col("v").alias("_d"))
    return replace(m, df=m.df.join(d, F.col("row") == F.col("_i")).select("row", "col", (F.col("_d") * F.col("val")).alias("val")))


def diagonal(m: SparseTable) -> DataFrame:
    """(i, v) of length min(rows, cols); 0 where nothing is stored."""
    own = m.df.filter("row = col").groupBy(F.col("row").alias("i")).agg(F.max("val").alias("d"))
    every = m.df.sparkSession.range(min(m.num_rows, m.num_cols)).select(F.col("id").alias("i"))
    return every.join(own, "i", "left").select("i", F.coalesce("d", F.lit(0.0)).alias("v"))


def fill_diagonal(m: SparseTable, value: float) -> SparseTable:
    """Stored diagonal entries become ``value``; none is added."""
    return replace(m, df=m.df.withColumn("val", F.when(F.col("row") == F.col("col"), F.lit(value)).otherwise(F.col("val"))))


def _same_shape(a: SparseTable, b: SparseTable) -> None:
    if (a.num_rows, a.num_cols) != (b.num_rows, b.num_cols):
        raise ValueError("shapes differ")


def combine(a: SparseTable, b: SparseTable, op=F.sum, of_a: Callable[[Column], Column] = lambda v: v, of_b: Callable[[Column], Column] = lambda v: v) -> SparseTable:
    """Union of both patterns after a map of each side; entries of one coordinate are folded with ``op``, an aggregate that
    does not depend on order. An entry that one side lacks takes no part: its partner stays as it is."""
    _same_shape(a, b)
    both = a.df.select("row", "col", of_a(F.col("val")).alias("val")).unionByName(b.df.select("row", "col", of_b(F.col("val")).alias("val")))
    return SparseTable(both.groupBy("row", "col").agg(op("val").alias("val")), a.num_rows, a.num_cols, "row_major")


def combine2(a: SparseTable, b: SparseTable, op, of_a: tuple, of_b: tuple) -> DataFrame:
    """(row, col, val0, val1): two value columns from two maps of each side, in one shuffle."""
    _same_shape(a, b)
    part = lambda m, f: m.df.select("row", "col", f[0](F.col("val")).alias("val0"), f[1](F.col("val")).alias("val1"))
    return part(a, of_a).unionByName(part(b, of_b)).groupBy("row", "col").agg(op("val0").alias("val0"), op("val1").alias("val1"))


def symmetrize_abs(m: SparseTable) -> SparseTable:
    """|A| + |A^T|."""
    m.square()
    return combine(m, m.transpose(), F.sum, F.abs, F.abs)


def pattern_symmetric(m: SparseTable) -> SparseTable:
    """A with explicit zeros where only A^T has an entry."""
    m.square()
    return combine(m, m.transpose(), F.sum, lambda v: v, lambda v: v * 0)


def symmetrize_both(m: SparseTable) -> DataFrame:
    """(row, col, val0, val1): both of the above at once."""
    m.square()
    return combine2(m, m.transpose(), F.sum, (F.abs, lambda v: v), (F.abs, lambda v: v * 0))


def equal(a: SparseTable, b: SparseTable, ordered: bool = False) -> DataFrame:
    """One row (equal): the same shape and entries with repeats; with ``ordered`` also at the same storage positions."""
    spark = a.df.sparkSession
    if (a.num_rows, a.num_cols) != (b.num_rows, b.num_cols):
        return spark.range(1).select(F.lit(False).alias("equal"))
    keys = ["pos"] * ordered + ["row", "col", "val"]
    left, right = (m.positions() if ordered else m.df.select("row", "col", "val") for m in (a, b))
    both = left.withColumn("_w", F.lit(1)).unionByName(right.withColumn("_w", F.lit(-1)))
    return both.groupBy(*keys).agg(F.sum("_w").alias("w")).agg(F.coalesce(F.bool_and(F.col("w") == 0), F.lit(True)).alias("equal"))

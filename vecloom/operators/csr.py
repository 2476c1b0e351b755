"""Compressed rows ``(row, cols, vals)`` with their shape and contracts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.convert import from_rows, to_rows
from vecloom.operators.sparse import SparseTable


def ascending(cols: Column) -> Column:
    """Each column id is at least the one before it."""
    return F.forall(F.sequence(F.lit(2), F.greatest(F.size(cols), F.lit(2))), lambda k: F.coalesce(F.try_element_at(cols, k) >= F.try_element_at(cols, k - 1), F.lit(True)))


@dataclass(frozen=True)
class RowTable:
    """A lazy matrix with one row of ``df`` for each of its rows, empty ones too.

    Rows are checked when they are read: as many columns as values, columns inside the shape and in ascending order, a row
    number inside the shape. A violation is an error of the query that reads it.
    """

    df: DataFrame
    num_rows: int
    num_cols: int

    def __post_init__(self):
        if self.num_rows < 0 or self.num_cols < 0:
            raise ValueError("bad shape")
        if [c for c in ("row", "cols", "vals") if c not in self.df.columns]:
            raise ValueError("needs the columns row, cols, vals")

    @staticmethod
    def from_coordinates(m: SparseTable) -> "RowTable":
        return RowTable(to_rows(m), m.num_rows, m.num_cols)

    @staticmethod
    def from_arrays(spark: SparkSession, values: Sequence[float], cols: Sequence[int], row_ptrs: Sequence[int], num_cols: int, kind: str = "double") -> "RowTable":
        """From driver-side arrays; pointers start at 0, do not descend and end at the number of values."""
        if not row_ptrs or row_ptrs[0] != 0 or row_ptrs[-1] != len(values) or len(values) != len(cols) or any(a > b for a, b in zip(row_ptrs, row_ptrs[1:])):
            raise ValueError("row pointers must go from 0 to the number of values, in ascending order")
        rows = [(r, list(cols[a:b]), list(values[a:b])) for r, (a, b) in enumerate(zip(row_ptrs, row_ptrs[1:]))]
        return RowTable(spark.createDataFrame(rows, f"row long, cols array<long>, vals array<{kind}>"), len(rows), num_cols)

    def checked(self) -> DataFrame:
        """(row, cols, vals), each row held against the contracts."""
        inside = F.forall("cols", lambda c: (c >= 0) & (c < self.num_cols))
        good = (F.size("cols") == F.size("vals")) & inside & ascending(F.col("cols")) & (F.col("row") >= 0) & (F.col("row") < self.num_rows)
        said = F.raise_error(F.concat(F.lit("bad compressed row "), F.coalesce(F.col("row").cast("string"), F.lit("null")))).cast("long")
        return self.df.select(F.when(F.coalesce(good, F.lit(False)), F.col("row")).otherwise(said).alias("row"), "cols", "vals")

    def coordinates(self, kind: str | None = None) -> SparseTable:
        """The coordinate form, with another element type if ``kind`` is given."""
        return from_rows(self.checked(), self.num_cols, self.num_rows, kind)

    def row(self, r: int) -> DataFrame:
        """(col, val) of one row."""
        if not 0 <= r < self.num_rows:
            raise ValueError("no such row")
        return self.checked().filter(F.col("row") == r).select(F.explode(F.arrays_zip("cols", "vals")).alias("e")).select(F.col("e.cols").alias("col"), F.col("e.vals").alias("val"))

    def pointers(self) -> DataFrame:
        """(line, ptr): the n + 1 row pointers."""
        from vecloom.operators.sparse import pointers

        return pointers(self.coordinates())

    def equal(self, other: "RowTable") -> DataFrame:
        """One row (equal): one shape, and the same columns and values in the same places."""
        if (self.num_rows, self.num_cols) != (other.num_rows, other.num_cols):
            return self.df.sparkSession.range(1).select(F.lit(False).alias("equal"))
        right = other.checked().select(F.col("row").alias("_r"), F.col("cols").alias("_c"), F.col("vals").alias("_v"))
        both = self.checked().join(right, F.col("row") == F.col("_r"), "full")
        same = F.col("cols").eqNullSafe(F.col("_c")) & F.col("vals").eqNullSafe(F.col("_v"))
        return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))

"""Between coordinate, compressed-row and dense forms, and extension of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.sparse import SparseTable, lines


def to_rows(m: SparseTable) -> DataFrame:
    """(row, cols, vals) with sorted cols, one row per matrix row, empty ones too."""
    entries = m.df.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("e"))
    every = lines(m, "row").withColumnRenamed("line", "row").join(entries, "row", "left")
    e = F.coalesce("e", F.array().cast(entries.schema["e"].dataType))
    return every.select("row", F.transform(e, lambda x: x["col"]).alias("cols"), F.transform(e, lambda x: x["val"]).alias("vals"))


def from_rows(rows: DataFrame, num_cols: int, num_rows: int | None = None, kind: str | None = None) -> SparseTable:
    """The coordinate form of (row, cols, vals); ``kind`` is another element type."""
    n = rows.count() if num_rows is None else num_rows
    val = F.col("e.vals") if kind is None else F.col("e.vals").cast(kind)
    df = rows.select("row", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("row", F.col("e.cols").alias("col"), val.alias("val"))
    return SparseTable(df, n, num_cols, "row_major")


def extend_rows(m: SparseTable, extra: int, value: float) -> SparseTable:
    """Each row gets ``extra`` more entries (or what fits) of ``value`` at its lowest free columns.

    The lowest ``extra`` free columns lie among the first entries + extra ones, so a candidate list is no longer than that,
    whatever the width of the matrix.
    """
    if extra < 0:
        raise ValueError("extra must not be negative")
    have = m.df.groupBy("row").agg(F.collect_set("col").alias("have"))
    rows = lines(m, "row").withColumnRenamed("line", "row").join(have, "row", "left").withColumn("have", F.coalesce("have", F.array().cast("array<bigint>")))
    last = F.least(F.lit(m.num_cols), F.size("have") + F.lit(extra)) - 1
    free = F.when(last >= 0, F.slice(F.array_except(F.sequence(F.lit(0).cast("long"), last.cast("long")), "have"), 1, max(extra, 1)))
    added = rows.select("row", F.explode(free).alias("col"), F.lit(value).alias("val")) if extra else m.df.limit(0).select("row", "col", "val")
    kind = m.df.schema["val"].dataType
    return SparseTable(m.df.select("row", "col", "val").unionByName(added.withColumn("val", F.col("val").cast(kind))), m.num_rows, m.num_cols, m.order)


def from_dense(dense: DataFrame, num_cols: int, num_rows: int) -> SparseTable:
    """From (row, vals) with arrays of all columns; zeros are not stored."""
    df = dense.select("row", F.posexplode("vals").alias("col", "val")).filter("val <> 0").withColumn("col", F.col("col").cast("long"))
    return SparseTable(df, num_rows, num_cols, "row_major")


def to_dense(m: SparseTable) -> DataFrame:
    """(row, vals) with arrays of all columns. A coordinate outside the shape or stored twice is an error."""
    cell = m.df.groupBy("row", "col").agg(F.count("*").alias("n"), F.first("val").alias("val"))
    bad = (F.col("n") > 1) | (F.col("row") < 0) | (F.col("row") >= m.num_rows) | (F.col("col") < 0) | (F.col("col") >= m.num_cols)
    cell = cell.select("row", "col", F.when(bad, F.raise_error(F.lit("coordinate repeated or out of range")).cast("double")).otherwise(F.col("val").cast("double")).alias("val"))
    held = cell.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("e"))
    every = lines(m, "row").withColumnRenamed("line", "row").join(held, "row", "left")
    columns = F.sequence(F.lit(0).cast("long"), F.lit(m.num_cols - 1).cast("long")) if m.num_cols else F.array().cast("array<bigint>")
    return every.select("row", F.transform(columns, lambda c: F.coalesce(F.try_element_at("e", c), F.lit(0.0))).alias("vals"))

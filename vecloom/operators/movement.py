"""Moving elements by index: gather, scatter, find, strided block copies, splitting and stacking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.operators.reduction import by_pointers


def gather(index: DataFrame, src: DataFrame, strict: bool = True) -> DataFrame:
    """(i, v) with v = src[index.v]; an index outside the source is an error, or null if not ``strict``."""
    rows = index.select("i", F.col("v").alias("at")).join(src.select(F.col("i").alias("s"), F.col("v").alias("val"), F.lit(True).alias("hit")), F.col("at") == F.col("s"), "left")
    missing = F.raise_error(F.concat(F.lit("no source element "), F.coalesce(F.col("at").cast("string"), F.lit("null")))).cast("long")
    i = F.when(F.col("hit").isNull(), missing).otherwise(F.col("i")) if strict else F.col("i")
    return rows.select(i.alias("i"), F.col("val").alias("v"))


def scatter(src: DataFrame, index: DataFrame, dst: DataFrame) -> DataFrame:
    """dst with dst[index[i]] = src[i]; of several writers the largest i wins; other elements stay."""
    sent = src.select("i", "v").join(index.select("i", F.col("v").alias("at")), "i")
    last = sent.groupBy("at").agg(F.max_by(F.struct("v"), "i").alias("new"))
    return dst.select("i", "v").join(last, F.col("i") == F.col("at"), "left").select("i", F.when(F.col("new").isNotNull(), F.col("new.v")).otherwise(F.col("v")).alias("v"))


def find(src: DataFrame, value, default: int | None = None) -> DataFrame:
    """One row (pos): the smallest index of ``value``, else ``default``."""
    return src.agg(F.coalesce(F.min(F.when(F.col("v") == F.lit(value), F.col("i"))), F.lit(default).cast("long")).alias("pos"))


def strided(t: Column, per_row: int, lead: int) -> Column:
    """Place of element t of a block with ``per_row`` elements a row in storage with row length ``lead``."""
    return t + F.floor(t / F.lit(per_row)).cast("long") * F.lit(lead - per_row)


def block_copy(src: DataFrame, n: int, src_row: int, src_lead: int, dst_row: int, dst_lead: int, write=None) -> DataFrame:
    """Copy n elements of a block with ``src_row`` of every ``src_lead`` elements to one with ``dst_row`` of ``dst_lead``.

    Result (i, v) with i the place in the destination. ``write`` maps the value on its way.
    """
    if min(src_row, dst_row) < 1 or src_lead < src_row or dst_lead < dst_row:
        raise ValueError("rows need 1 <= elements <= lead")
    # The source place is invertible, so the copy is a projection of the source, not a join.
    line, col = F.floor(F.col("i") / F.lit(src_lead)).cast("long"), F.pmod(F.col("i"), F.lit(src_lead))
    t = line * src_row + col
    value = F.col("v") if write is None else write(F.col("v"))
    return src.filter(col < src_row).select(t.alias("t"), value.alias("v")).filter(F.col("t") < n).select(strided(F.col("t"), dst_row, dst_lead).alias("i"), "v")


def split_at(pool: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n elements, and the rest from index 0 on."""
    return pool.filter(F.col("i") < n), pool.filter(F.col("i") >= n).withColumn("i", F.col("i") - n)


def spans(*ranges: DataFrame) -> DataFrame:
    """Several vectors as one table (src, i, v)."""
    out = None
    for k, x in enumerate(ranges):
        x = x.select(F.lit(k).alias("src"), "i", "v")
        out = x if out is None else out.unionByName(x)
    return out


def spans_from_pointers(x: DataFrame, ptrs: DataFrame) -> DataFrame:
    """One vector cut at ascending ``ptrs(line, ptr)`` into n views: (src, i, v), i from 0 in each; a view may be empty."""
    ends = ptrs.select((F.col("line") - 1).alias("line"), F.col("ptr").alias("hi"))
    views = ptrs.join(ends, "line").select(F.col("line").alias("seg"), F.col("ptr").alias("lo"), "hi")
    own = by_pointers(x.select("i", "v"), views).join(views.select(F.col("seg").alias("_s"), F.col("lo").alias("_lo")), F.col("seg") == F.col("_s"))
    return own.select(F.col("seg").alias("src"), (F.col("i") - F.col("_lo")).alias("i"), "v")


def prefetch(df: DataFrame) -> DataFrame:
    """Keep the rows in the executors' storage from the first use on."""
    return df.persist()

"""Matrix Market files: coordinate and array layout, every real field and symmetry, one file or a folder of parts."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.sparse import SparseTable

LAYOUTS = ("coordinate", "array")
FIELDS = ("real", "double", "integer", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric")
BANNER = "%%MatrixMarket"
#: Lines of comments that may stand before the size line.
HEAD_LINES = 10_000


@dataclass(frozen=True)
class Header:
    layout: str
    field: str
    symmetry: str
    num_rows: int
    num_cols: int
    entries: int | None
    size_line: str


def _lines(spark: SparkSession, path: str):
    """The first lines of a file, or of the first file by name in a folder, read by the driver from any store of Spark's."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        names = sorted(str(f.getPath()) for f in fs.listStatus(at) if f.isFile() and f.getPath().getName()[0] not in "._")
        if not names:
            return
        at = jvm.org.apache.hadoop.fs.Path(names[0])
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(at), "UTF-8"))
    try:
        for _ in range(HEAD_LINES):
            line = reader.readLine()
            if line is None:
                return
            yield line
    finally:
        reader.close()


def header(spark: SparkSession, path: str) -> Header:
    lines = _lines(spark, path)
    words = next(lines, "").lower().split()
    if len(words) < 5 or words[:2] != [BANNER.lower(), "matrix"] or words[2] not in LAYOUTS or words[3] not in FIELDS or words[4] not in SYMMETRIES or (words[2] == "array" and words[3] == "pattern"):
        raise ValueError("not a real Matrix Market matrix")
    size_line = next((x for x in lines if x.strip() and not x.startswith("%")), "")
    size = size_line.split()
    if len(size) != (3 if words[2] == "coordinate" else 2) or not all(x.isdigit() for x in size):
        raise ValueError("the size line is missing")
    if words[4] != "general" and size[0] != size[1]:
        raise ValueError("a symmetric matrix must be square")
    return Header(words[2], words[3], words[4], int(size[0]), int(size[1]), int(size[2]) if len(size) == 3 else None, size_line)


def _checked(good: Column, value: Column, what: str, text: Column) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(what + ": "), F.coalesce(text, F.lit("")))).cast("long"))


def read(spark: SparkSession, path: str) -> SparseTable:
    """The matrix, 0-based; symmetric ones get both halves, skew ones with the other sign. A pattern's values are 1.

    An entry outside the shape or with another number of fields is an error, as is another number of entries than the size
    line tells. Entries may stand in any order and in any part of a folder; only the array layout, whose places are its
    order of lines, must be one file.
    """
    h = header(spark, path)
    body = spark.read.text(path).filter(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0))
    one = F.col("value") == F.lit(h.size_line)
    if h.layout == "array":
        # Lines are numbered by their split's place in the file, then inside it.
        rows = body.select("value", F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("k"))
        sizes = rows.groupBy("s").agg(F.count("*").alias("n"), F.min("k").alias("k0"))
        starts = sizes.collect()  # one row for each split
        before, total = {}, 0
        for r in sorted(starts):
            before[r["s"]] = (total, r["k0"])
            total += r["n"]
        place = F.create_map(*[F.lit(x) for s, (n, k0) in before.items() for x in (s, n - k0)])
        at = F.col("k") + F.element_at(place, F.col("s")) - 1  # the size line is the first
        half = h.symmetry != "general"
        n = h.num_rows
        counts = [n - c - (h.symmetry == "skew-symmetric") for c in range(h.num_cols)] if half else []
        want = sum(counts) if half else h.num_rows * h.num_cols
        if total - 1 != want:
            raise ValueError(f"{total - 1} values where {want} are due")
        rows = rows.select(at.alias("at"), F.trim("value").cast("double").alias("val")).filter("at >= 0")
        if half:
            ends = [sum(counts[: c + 1]) for c in range(len(counts))]
            col = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("at"))).cast("long")
            rows = rows.withColumn("col", col)
            first = F.element_at(F.array(*[F.lit(e - k) for e, k in zip(ends, counts)]), (F.col("col") + 1).cast("int"))
            rows = rows.select((F.col("at") - first + F.col("col") + int(h.symmetry == "skew-symmetric")).alias("row"), "col", "val")
        else:
            rows = rows.select((F.col("at") % n).alias("row"), F.floor(F.col("at") / n).cast("long").alias("col"), "val")
    else:
        # The size line can look like an entry, so exactly one line of its text goes.
        twins = body.filter(one).groupBy("value").count().select("value", F.explode(F.expr("CASE WHEN count > 1 THEN sequence(2L, count) END"))).select("value")
        x = F.split(F.trim("value"), r"\s+")
        rows = body.filter(~one).select("value").unionByName(twins).select("value", x.alias("x"))
        fields = 2 if h.field == "pattern" else 3
        row, col = F.col("x")[0].cast("long") - 1, F.col("x")[1].cast("long") - 1
        good = (F.size("x") == fields) & row.between(0, h.num_rows - 1) & col.between(0, h.num_cols - 1)
        total = rows.agg(F.count("*")).scalar()
        good = good & (total == F.lit(h.entries))
        val = F.lit(1.0) if h.field == "pattern" else F.col("x")[2].cast("double")
        rows = rows.select(_checked(good, row, "entry outside the shape, or their number differs", F.col("value")).alias("row"), col.alias("col"), val.alias("val"))
    if h.symmetry != "general":
        sign = F.col("val") if h.symmetry == "symmetric" else -F.col("val")
        rows = rows.unionByName(rows.filter("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), sign.alias("val")))
    return SparseTable(rows.select("row", "col", "val"), h.num_rows, h.num_cols)


def write(m: SparseTable, path: str) -> None:
    """Coordinate layout under the folder ``path``: parts of entries, and the banner and size in a first file of its own."""
    spark = m.df.sparkSession
    number = lambda c: (F.col(c) + 1).cast("string")
    m.df.select(F.concat_ws(" ", number("row"), number("col"), F.col("val").cast("double").cast("string")).alias("value")).write.text(path)
    entries = spark.read.text(path).count()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path, "a-head.mtx")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(f"{BANNER} matrix coordinate real general\n{m.num_rows} {m.num_cols} {entries}\n".encode()))
    finally:
        out.close()


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; a private one in local mode with none set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vecloom-")
    return f"{base.rstrip('/')}/vecloom-matrix-{uuid.uuid4().hex}"

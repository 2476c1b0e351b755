"""Helpers that several corpus operators share: the cluster's shared folder, Arrow row access and word rules."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow text is handed on in slices of about this many bytes, so that a task's memory does not follow the batch size.
SLICE_BYTES = 4 << 20
TEXT_ROWS = 2000
#: Bytes of a batch of texts that goes to Python.
BATCH_BYTES = 16 << 20

_own_dir: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a private one only in local mode with the setting unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="vecloom-")
    return _own_dir[app]


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/vecloom-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more: what was made of them is stored itself."""
    for df in tables:
        _written.remove(df.stored_at)
        _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every table and file that operators left in the shared folder; results not yet consumed become unreadable."""
    while _written:
        _delete(spark, _written.pop())


def only(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, so that extra or clashing columns of the input play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str, bound: int, rows: int) -> DataFrame:
    """Join; ``right`` is broadcast only if its counted ``rows`` are at most ``bound``, and is shuffled otherwise."""
    right = F.broadcast(right) if rows <= bound else right
    cond = None
    for name in on:
        same = left[name].eqNullSafe(right[f"_{name}"])
        cond = same if cond is None else cond & same
    return left.join(right, cond, how).drop(*[f"_{name}" for name in on])


def keyed(df: DataFrame, *names: str) -> DataFrame:
    """Prefix the join keys of a right side for :func:`joined`."""
    for n in names:
        df = df.withColumnRenamed(n, f"_{n}")
    return df


def text_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in batches of TEXT_ROWS rows and about BATCH_BYTES at most; Spark's defaults are too much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` that hold about ``size`` bytes of ``column`` each (one row at least)."""
    sizes = batch.column(column)
    first, held = 0, 0
    lengths = pc.binary_length(sizes).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


def texts(batch: pa.RecordBatch, column: str, first: int, end: int) -> list[bytes]:
    """UTF-8 bytes of a row range; null is empty."""
    part = batch.column(column).slice(first, end - first)
    return [x or b"" for x in part.cast(pa.binary()).to_pylist()]


#: Words of long texts are taken from pieces of about this many bytes, so Python objects exist for one piece at a time.
PIECE_BYTES = 2 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, a list for each piece; pieces are cut at white space."""
    if len(text) <= size:
        yield text.split()
        return
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends, in bytes."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    return turn[::2], turn[1::2]


def hashed_words(text: bytes, digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> np.ndarray:
    """64-bit hash of each word."""
    parts = [np.fromiter(map(digest, words), np.uint64, len(words)) for words in word_pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def trim() -> None:
    """Give freed memory of a Python worker back to the machine; workers outlive tasks and are shared by queries."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function of Arrow batches that ends by giving its worker's freed memory back."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return trimmed


def word_count(text: Column) -> Column:
    """Number of words; null counts 0. Word starts are kept as one mark each, so no array of words is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

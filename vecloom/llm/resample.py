"""Quality selection by importance resampling.

Two generative models over hashed word unigrams and bigrams are counted: of target text (documents labelled good) and of
all raw text. A document's log weight is the log ratio of its probability under the two; with Gumbel noise added, the k
largest keys are a sample without replacement in proportion to the weights.

The k-th key is found exactly by four rounds of counting 16 bits of the key each; nothing is sorted globally or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import hashed_words, lean, only, slices, stored, text_batches, texts

BUCKETS = 1 << 16
SMOOTH = 0.1
#: The target model is fitted to at most this many good documents, those of least hash; their ids are sent to the executors.
TARGET_SAMPLE = 50_000
SEED = 11


def features(text: bytes) -> np.ndarray:
    """Buckets of all words and word pairs of a text, A-Z lowered."""
    h = hashed_words(text.lower())
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    both = np.concatenate([h, pairs * np.uint64(0xC2B2AE3D27D4EB4F)])
    return (both >> np.uint64(48)).astype(np.int64) % BUCKETS


def noise(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Gumbel noise from a hash of each id."""
    u = np.array([(xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), seed) >> 11) + 0.5 for i in ids]) / float(1 << 53)
    return -np.log(-np.log(u))


def ordered(key: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = (key + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-1) ^ (bits & np.int64(0x7FFFFFFFFFFFFFFF)), bits)


def kth_key(keys: DataFrame, k: int) -> int:
    """The k-th largest value of the long column ``order`` (1 <= k <= rows), by counts of 16 bits at a time."""
    flipped = F.col("order").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    prefix, rest = 0, k
    for shift in (48, 32, 16, 0):
        rows = keys if shift == 48 else keys.filter(F.shiftrightunsigned(flipped, shift + 16) == F.lit(prefix))
        bins = rows.groupBy(F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit(0xFFFF)).alias("bin")).count().collect()  # 65,536 rows at most
        for b, n in sorted(bins, reverse=True):
            if n >= rest:
                prefix = (prefix << 16) | b
                break
            rest -= n
    return prefix - (1 << 63)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, sample: int = TARGET_SAMPLE, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, key, selected), one row per row of ``docs(doc_id, text)``.

    Target: documents that ``labels(doc_id, quality)`` rates 1. k is ``share`` of all rows, by default the share of good
    ones among the labelled. Rows that tie with the k-th key (repeated rows) are all selected. Null or empty text has log
    weight 0. Without a target document all weights are 0 and half the rows are drawn.
    """
    text_batches(docs.sparkSession)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = only(labels, "doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    marks = stored(marks, "marks")
    good = marks.filter("q = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    target = np.sort(np.array([r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()], np.int64))
    if share is None:
        share = marks.agg(F.avg(F.when(F.col("q") == 1, 1.0).otherwise(0.0))).first()[0]
        share = 0.5 if share is None else share

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, own = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-(1 << 62)).to_numpy()
            hit = np.isin(ids, target)
            for a, b in slices(batch, "text"):
                for i, text in enumerate(texts(batch, "text", a, b), a):
                    c = np.bincount(f, minlength=BUCKETS) if len(f := features(text)) > 4096 else None
                    for into in (raw, own) if hit[i] else (raw,):
                        if c is None:
                            np.add.at(into, f, 1)
                        else:
                            into += c
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(own[at])], ["bucket", "raw", "own"])

    table = rows.mapInArrow(lean(count), "bucket long, raw long, own long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).toArrow()
    raw, own = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    at = table.column("bucket").to_numpy()
    raw[at] += table.column("raw").to_numpy()
    own[at] += table.column("own").to_numpy()
    ratio = np.log(own / own.sum()) - np.log(raw / raw.sum()) if len(target) else np.zeros(BUCKETS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                weight = np.array([ratio[features(t)].sum() for t in texts(batch, "text", a, b)], np.float64)
                ids = batch.column("doc_id").slice(a, b - a)
                key = weight + noise(ids.fill_null(-(1 << 62)).to_numpy(), seed)
                yield pa.RecordBatch.from_arrays([ids, pa.array(weight), pa.array(key), pa.array(ordered(key))], ["doc_id", "log_weight", "key", "order"])

    scored = stored(rows.mapInArrow(lean(score), "doc_id long, log_weight double, key double, order long"), "scored")
    n = scored.count()
    k = min(n, round(share * n))
    cut = F.lit(False) if k < 1 else F.col("order") >= F.lit(kth_key(scored, k))
    return scored.select("doc_id", "log_weight", "key", cut.alias("selected"))


def op6_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

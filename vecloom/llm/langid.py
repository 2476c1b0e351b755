"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit a binary n-gram classifier tells the languages with a 1 from those with a 0, by
the log ratio of the two groups' mean distributions of hashed byte n-grams. A text's margins are decoded to the codeword
with the least loss, where a bit weighs as much as its classifier separates that language (the expected margin). The score
is the share of the best codeword in exp(-loss); a text is flagged ambiguous if it is below ``AMBIGUOUS``.

Fitting counts n-grams of all labelled rows on the executors; the driver gets one row per language and n-gram bucket, a
size that does not follow the rows. At most ``MOST_LANGS`` languages are learned, those with the most labelled rows.
Prediction is one pass in numpy over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import lean, only, slices, text_batches, word_pieces

BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
SMOOTH = 0.5
#: n-grams of one text overlap and repeat, so they count as this many at most.
EVIDENCE = 200
AMBIGUOUS = 0.55
SEED = 5
UNKNOWN = "und"
#: Languages that are learned at most: a task holds 128 KB for each, the driver at most 16,384 rows.
MOST_LANGS = 256
#: Long texts are counted in pieces of this many bytes (with the overlap that n-grams need), so memory is bounded.
PIECE = 1 << 20

PLAIN_LETTER = re.compile("[A-Za-z]")
#: A-Z lowered, other ASCII than letters to spaces, bytes of longer characters kept.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode categories L is in the text."""
    return bool(PLAIN_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


def grams(text: str, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Counts of hashed byte n-grams of the whole text, words separated by one space."""
    counts, longest = np.zeros(buckets, np.int64), max(orders)

    def add(data: bytes, own: int) -> None:
        """n-grams that start at the first ``own`` places."""
        v = np.frombuffer(data, np.uint8).astype(np.uint32)
        g = np.zeros(len(v), np.uint32)
        for n in range(1, longest + 1):
            if len(v) < n:
                break
            g = g[: len(v) - n + 1] * np.uint32(257) + v[n - 1 :]
            if n in orders:
                h = ((g[:own] + np.uint32(n * 0x9E3779)) * np.uint32(2654435761)) >> np.uint32(18)
                counts[:] += np.bincount(h % np.uint32(buckets), minlength=buckets)

    held = b" "
    for words in word_pieces(text.encode("utf-8", "replace").translate(PLAIN), PIECE):
        held += b" ".join([*words, b""])
        if len(held) >= longest:  # the last ones wait for what follows
            own = len(held) - longest + 1
            add(held, own)
            held = held[own:]
    add(held, len(held))
    return counts


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """(n, bits) of +-1: all distinct splits for up to 5 classes, else random splits, about 12 bits a doubling, and more until
    any two codewords differ in a quarter of them, so that wrong bits of an eighth are corrected."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1] + [1 if s >> (c - 1) & 1 else -1 for c in range(1, n)] for s in range(2 ** (n - 1) - 1)]).T.astype(float)
    rng, cols = np.random.default_rng(seed), []
    while len(cols) < int(12 * np.ceil(np.log2(n))) or 4 * distance(np.array(cols).T) < len(cols):
        col = rng.choice([-1.0, 1.0], n)
        if abs(col.sum()) <= n / 2:
            cols.append(col)
    return np.array(cols).T


def distance(code: np.ndarray) -> int:
    """The fewest bits that two codewords differ in."""
    alike = code @ code.T
    return int(min((code.shape[1] - alike[a, b]) / 2 for a, b in combinations(range(len(code)), 2)))


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous); ``und`` with score 0 if nothing can be told."""
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        counts = grams(text)
        total = max(1, counts.sum())
        margins = counts @ self.weights * (min(total, EVIDENCE) / total / len(ORDERS))
        loss = (self.trust * np.logaddexp(0, -self.code * margins)).sum(1)
        share = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        score = float(share[best] / share.sum())
        return self.langs[best], score, score < AMBIGUOUS


def fit_counts(langs: list[str], counts: np.ndarray, smooth: float = SMOOTH) -> Model:
    """Model from n-gram counts (languages, buckets)."""
    code = codewords(len(langs))
    p = counts + smooth
    p = p / p.sum(1, keepdims=True)
    weights, trust = np.zeros((counts.shape[1] if len(counts) else BUCKETS, code.shape[1])), np.zeros(code.shape)
    if len(langs) > 1:
        for b in range(code.shape[1]):
            weights[:, b] = np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0))
        trust = np.maximum(code * (p @ weights), 1e-9)
        trust = trust / trust.sum(1, keepdims=True)
    return Model(langs, code, weights, trust)


def fit(docs: DataFrame, learn: Column) -> Model:
    """Fit to all rows of ``docs(text, lang)`` that meet ``learn`` and have both text and lang (one of the ``MOST_LANGS`` with the
    most such rows, ties by name)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += grams(text.as_py())
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    text_batches(docs.sparkSession)
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGS).collect()]
    rows = rows.filter(F.col("lang").isin(known))
    table = rows.mapInArrow(lean(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS), np.int64)
    place = {x: i for i, x in enumerate(langs)}
    if langs:
        counts[[place[x] for x in table.column("lang").to_pylist()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return fit_counts(langs, counts)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` with lang_pred, score and ambiguous; only the text decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "_text"):
                part = batch.slice(a, b - a)
                lang, score, doubt = zip(*(model.predict(t.as_py()) for t in part.column("_text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], [*keep, "lang_pred", "score", "ambiguous"])

    text_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "lang_pred string, score double, ambiguous boolean"])
    return rows.mapInArrow(lean(run), schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told without doubt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not model.predict(t.as_py())[2] for t in batch.column("text")], pa.bool_()))

    text_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows; a text that is null or has no letter (Unicode category L) has lang_pred ``und`` and score 0. Rows without doc_id
    are neither held out nor learned from. Evidence counts as ``EVIDENCE`` n-grams at most, so scores of long texts do not
    all end at 1."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(docs, ~F.col("held_out") & F.col("doc_id").isNotNull())
    return identify(docs, model, "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score", "ambiguous")

"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A document leaks an item if it holds at least ``THRESHOLD`` of the item's distinct word shingles. Comparing whole MinHash
signatures cannot see a short item inside a long document (their Jaccard similarity vanishes), so the sketch is one-sided:
items are partitioned by the number of their shingles, and a partition fixes how many least hashes of an item (its bottom-k
MinHash) are indexed: one more than the shingles that an item of its largest size may miss. A document that leaks an item
misses fewer than that, so it holds at least one indexed hash: no leak is lost at any document length. Candidates are
verified by exact containment of the shingles themselves.

Documents are read once, however many items there are. Items of up to ``BLOCK_BYTES`` of text (counted) are sent to the
executors as one index, which a worker builds once; documents are not shuffled then. More items are met by a shuffle join of
documents' shingle hashes with the indexed ones, and only texts of candidates travel.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import hashed_words, lean, only, slices, stored, text_batches, texts, word_spans

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 16 << 20
#: A word is a run of ASCII letters, digits and characters outside ASCII; A-Z count as a-z.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, from the words' hashes."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ h[i : n + i]) * MULT
        out ^= out >> np.uint64(29)
    return out


def shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def sketch_size(n: int, threshold: float) -> int:
    """Least hashes indexed for an item of ``n`` shingles; depends only on its size partition (2^j, 2^(j+1)]."""
    largest = 1 << max(0, (n - 1).bit_length())
    return min(n, largest - math.ceil(threshold * largest - 1e-9) + 1)


def sketch(text: bytes, width: int, threshold: float) -> tuple[int, list[bytes], np.ndarray, np.ndarray]:
    """(shingle width, distinct shingles, their hashes, those that are indexed) of an item's text; width 0 without words."""
    words = words_of(text)
    own = min(width, len(words))
    parts = sorted(shingles(words, own)) if words else []
    hashes = np.array([int(shingle_hashes(hashed_words(p), own)[0]) for p in parts], np.uint64)
    return own, parts, hashes, np.unique(hashes)[: sketch_size(len(parts), threshold)] if parts else hashes


class Text:
    """A document's words as hashes and places; shingles are compared as themselves."""

    def __init__(self, text: bytes):
        self.plain = text.translate(PLAIN)
        self.words = hashed_words(self.plain)
        self.spans = None
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hashes(self, width: int) -> np.ndarray:
        return shingle_hashes(self.words, width)

    def holds(self, width: int, part: bytes, digest: int) -> bool:
        if width not in self.sorted:
            h = self.hashes(width)
            order = np.argsort(h, kind="stable")
            self.sorted[width] = h[order], order
        if self.spans is None:
            self.spans = word_spans(self.plain)
        h, order = self.sorted[width]
        first, end = self.spans
        a, b = np.searchsorted(h, np.uint64(digest), "left"), np.searchsorted(h, np.uint64(digest), "right")
        return any(b" ".join(self.plain[first[k] : end[k + width - 1]].split()) == part for k in order[a:b].tolist())

    def shared(self, width: int, parts: list[bytes], hashes: np.ndarray) -> int:
        return sum(self.holds(width, p, h) for p, h in zip(parts, hashes.tolist()))


class Index:
    """Bottom-k MinHash index of items, one table for each shingle width."""

    def __init__(self, items: list[tuple[int | None, int, bytes]], width: int, threshold: float):
        self.threshold = threshold
        self.items, self.tables = [], {}
        owners: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, copies, text in items:
            own, parts, hashes, indexed = sketch(text, width, threshold)
            if not parts:
                continue
            for h in indexed.tolist():
                owners[own][h].append(len(self.items))
            self.items.append((item_id, copies, own, parts, hashes))
        for own, found in owners.items():
            self.tables[own] = (np.array(sorted(found), np.uint64), dict(found))

    def leaks(self, text: bytes) -> Iterator[tuple[int | None, int, int, int]]:
        """(item_id, copies, shingles of the item, of those in the text) of each item that leaks."""
        doc = Text(text)
        for own, (keys, owners) in self.tables.items():
            h = doc.hashes(own)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == h)
            for place in sorted({p for x in np.unique(h[hit]).tolist() for p in owners[x]}):
                item_id, copies, _, parts, hashes = self.items[place]
                shared = doc.shared(own, parts, hashes)
                if shared >= self.threshold * len(parts) - 1e-9:
                    yield item_id, copies, len(parts), shared


#: The index that this worker holds, by a name.
_held: dict[str, Index] = {}


def index_of(name: str, sent, width: int, threshold: float) -> Index:
    if name not in _held:
        _held.clear()
        _held[name] = Index(sent.value, width, threshold)
    return _held[name]


FOUND = "doc_id long, item_id long, copies long, item_shingles long, shared long, containment double"


def found_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.float64()]
    columns = zip(*out) if out else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "copies", "item_shingles", "shared", "containment"])


def distinct_items(items: DataFrame) -> DataFrame:
    """(text, item_id, copies): distinct item texts with their smallest item_id and number."""
    rows = only(items, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.filter("text IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies")), "items")


def sent_index(items: DataFrame, block_bytes: int) -> tuple[str, object] | None:
    """A name and the broadcast items, if their texts, counted, are at most ``block_bytes``."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return None
    block = [(r["item_id"], r["copies"], r["text"].encode()) for r in items.collect()]
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(block)


def candidates(rows: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """(mark, items): for distinct texts of ``rows(mark, text)`` the items that share an indexed hash, by a shuffle join."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(texts(batch, "text", 0, batch.num_rows)):
                own, _, _, indexed = sketch(text, width, threshold)
                h = pa.array(indexed.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("item")[i].as_py()] * len(h), pa.int64()), pa.array([own] * len(h), pa.int32()), h], ["item", "w", "h"])

    named = items.withColumn("item", F.xxhash64("text"))
    indexed = stored(named.select("item", "text").mapInArrow(lean(index), "item long, w int, h long"), "item-hashes")
    widths = sorted(r["w"] for r in indexed.select("w").distinct().collect())  # at most ``width``

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_pylist()
            for a, b in slices(batch, "text"):
                for i, text in enumerate(texts(batch, "text", a, b), a):
                    doc = Text(text)
                    for w in widths:
                        h = np.unique(doc.hashes(w)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), marks[i], np.int64)), pa.array(np.full(len(h), w, np.int32)), pa.array(h)], ["mark", "dw", "dh"])

    held = rows.mapInArrow(lean(hashes), "mark long, dw int, dh long")
    met = held.join(indexed, (F.col("dw") == F.col("w")) & (F.col("dh") == F.col("h"))).select("mark", "item").distinct()
    item = F.struct("item_id", "copies", "text").alias("item_text")
    whole = met.join(named.select(F.col("item").alias("n"), item), F.col("item") == F.col("n"))
    return stored(whole.groupBy(F.col("mark").alias("m")).agg(F.collect_list("item_text").alias("items")), "candidates")


def find_leaks(docs: DataFrame, items: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, copies, item_shingles, shared, containment) for each document row and distinct item text that it leaks.

    Items of equal text are one item, under the smallest item_id, with their number in ``copies``. An item of fewer words
    than ``width`` is one shingle of all its words. Items without words and null texts leak nowhere; an empty side gives no
    row. Rows without an id keep a null id; repeated document rows give repeated results.
    """
    text_batches(docs.sparkSession)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    items = distinct_items(items)
    index = sent_index(items, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index_of(*index, width, threshold)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b in slices(batch, "text"):
                yield found_batch([(ids[i], x, c, n, s, s / n) for i, text in enumerate(texts(batch, "text", a, b), a) for x, c, n, s in own.leaks(text)])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, near, out = batch.column("doc_id").to_pylist(), batch.column("items"), []
            for i, text in enumerate(texts(batch, "text", 0, batch.num_rows)):
                doc = Text(text)
                for item in near[i].as_py():
                    own, parts, hashes, _ = sketch(item["text"].encode(), width, threshold)
                    shared = doc.shared(own, parts, hashes)
                    if shared >= threshold * len(parts) - 1e-9:
                        out.append((ids[i], item["item_id"], item["copies"], len(parts), shared, shared / len(parts)))
            yield found_batch(out)

    if index is not None:
        return rows.mapInArrow(lean(run), FOUND)
    marked = rows.withColumn("mark", F.xxhash64("text"))
    near = candidates(marked.select("mark", "text"), items, width, threshold)
    return marked.join(near, F.col("mark") == F.col("m")).select("doc_id", "text", "items").mapInArrow(lean(verify), FOUND)


def without_leaks(docs: DataFrame, items: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns. Null texts stay."""
    text_batches(docs.sparkSession)
    index = sent_index(distinct_items(items), block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index_of(*index, width, threshold)
        for batch in batches:
            for a, b in slices(batch, "text"):
                clean = [next(own.leaks(text), None) is None for text in texts(batch, "text", a, b)]
                yield batch.slice(a, b - a).filter(pa.array(clean))

    if index is not None:
        return docs.mapInArrow(lean(run), docs.schema)
    mark = F.xxhash64(docs["text"].cast("string"))
    distinct = docs.select(mark.alias("doc_id"), "text").filter("text IS NOT NULL")
    leaked = find_leaks(distinct, items, width, threshold, block_bytes).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(stored(leaked, "leaked"), docs["text"].isNotNull() & (mark == F.col("_leaked")), "left_anti")


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
OP8_SQL = rf"""
WITH i AS (SELECT min(item_id) AS item_id, count(*) AS copies, {WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL GROUP BY text),
iw AS (SELECT *, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, copies, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(list_slice(w, p, p + k - 1), ' '))) AS g FROM iw),
n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT rid, doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(list_slice(w, p, p + k - 1), ' '))) AS g
  FROM d, (SELECT DISTINCT k FROM iw)),
h AS (SELECT ds.rid, ds.doc_id, s.item_id, s.copies, count(*) AS shared FROM ds JOIN s ON ds.k = s.k AND ds.g = s.g GROUP BY ALL)
SELECT doc_id, h.item_id, copies, item_shingles, shared, CAST(shared AS DOUBLE) / CAST(item_shingles AS DOUBLE) AS containment
FROM h JOIN n ON h.item_id = n.item_id WHERE shared >= 0.8 * item_shingles - 1e-9
"""

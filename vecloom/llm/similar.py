"""Near-copies at a shingle similarity: wide SimHash fingerprints compared in tiles, then exact similarity of shingle sets.

A radius of a few bits of a 64-bit fingerprint finds only very close copies, and its bands cannot serve a large radius. Here
a fingerprint has ``LANES`` x 64 bits over the set of a text's word shingles and is only a filter: its radius is
``DEVIATIONS`` standard deviations above what a pair at the threshold differs in on average, and a pair counts only if the
Jaccard similarity of its shingle sets reaches the threshold. Tiles are cut from blocks of points that share one of
``BANDS`` keys of ``ROWS`` MinHash values each: a pair of similarity 0.8 shares none with a chance of 0.2 %. Texts of equal
words are one point. As in :mod:`simhash`, a block's points stand in order of their population counts, a tile has one count, and
tile pairs whose counts differ by more than the radius are skipped. A block is dealt in slabs of neighbouring counts; pairs of
slabs go to many tasks, but for those whose counts are all too far apart.

Points that share no key with another leave first, so that only the crowded ones travel. Sets of a large group are not
compared pair by pair: in ``STARS`` rounds each point is compared with one hub, the closest of those of its blocks that are
not in its group yet; then every candidate between two different groups is. For these two exact bounds come first, which
edited copies of one text that are far from each other fail: what two points share lies in their shingles that are not theirs
alone, and each bit that only one of their bitmaps of shingles has set is a shingle that the other lacks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import hashed_words, lean, only, slices, stored, text_batches, texts, word_pieces
from vecloom.llm.components import components
from vecloom.llm.leaks import shingle_hashes
from vecloom.llm.simhash import tiles_of

SIMILARITY = 0.8
SHINGLE = 5
LANES = 8
BANDS, ROWS = 12, 4
TILE = 256
SEED = 3
#: Standard deviations between the mean distance at the threshold and the filter's radius.
DEVIATIONS = 5
#: Sets up to this size are not filtered by fingerprint: their majority bits do not follow the angle. They stand first, with UNCOUNTED
#: for a population count, and their tiles are never skipped.
SMALL = 8
UNCOUNTED = -1
#: Shingles that are hashed at a time.
PIECE = 4096
#: Rounds of links to hubs before all other candidates.
STARS = 2
#: Candidate pairs that are handed on at a time.
PAIRS = 1 << 16
#: Bits of a bitmap of shingles.
BITMAP = 1024
#: Marks (16 bytes each) and rows that go (16 bytes each) up to this many are broadcast; more are joined by a shuffle.
BROADCAST_MARKS = 250_000


def odd(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers from a hash."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed) | 1 for i in range(n)], np.uint64)


LANE_BY, ROW_BY = odd(LANES, SEED), odd(BANDS * ROWS, SEED + 1)


def mixed(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Independent hashes (len(h), len(by)) of each value."""
    x = h[:, None] * by
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order, from the words' hashes."""
    return np.unique(shingle_hashes(words, min(width, max(1, len(words)))))


def sketch(text: bytes, width: int = SHINGLE) -> tuple[int, bytes, list[int]]:
    """(hash of the words, fingerprint, block keys); a text without words has no keys. A-Z are lowered."""
    return sized_sketch(text, width)[:3]


def sized_sketch(text: bytes, width: int = SHINGLE) -> tuple[int, bytes, list[int], int]:
    """The sketch and the number of distinct shingles."""
    text = text.lower()
    line = xxhash.xxh64()
    for k, words in enumerate(word_pieces(text)):
        line.update(b" " * (k > 0) + b" ".join(words))
    mark = line.intdigest()
    h = shingle_set(hashed_words(text), width)
    if not len(h):
        return mark, bytes(8 * LANES), [], 0
    ones, least = np.zeros(64 * LANES, np.int64), np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), PIECE):
        part = h[at : at + PIECE]
        ones += np.unpackbits(mixed(part, LANE_BY).view(np.uint8), axis=1).sum(0, dtype=np.int64)
        least = np.minimum(least, mixed(part, ROW_BY).min(0))
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return mark, np.packbits(ones * 2 > len(h)).tobytes(), keys, len(h)


def radius_of(similarity: float, bits: int = 64 * LANES) -> int:
    """Bits that fingerprints of two sets of one size and this Jaccard similarity differ in, on average."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def reach(similarity: float, bits: int = 64 * LANES) -> int:
    """Radius of the filter: a pair at ``similarity`` lies beyond it with a chance below 1e-4."""
    mean = radius_of(similarity, bits)
    return math.ceil(mean + DEVIATIONS * math.sqrt(mean * (1 - mean / bits)))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of two sets in ascending order."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / (len(x) + len(y) - shared)


class Side:
    """The points of a slab in order of ``ones``, their population counts; ``rests`` are their numbers of shingles that others have
    too, ``bits`` their bitmaps."""

    def __init__(self, marks: np.ndarray, prints: np.ndarray, ones: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rests: np.ndarray, bits: np.ndarray):
        order = np.argsort(ones, kind="stable")
        self.marks, self.prints, self.ones, self.sizes, self.labels, self.rests, self.bits = (v[order] for v in (marks, prints, ones, sizes, labels, rests, bits))


def near_tiles(x: np.ndarray, y: np.ndarray, radius: int, tile: int, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, b, places): each tile [a, b) of one population count in the order ``x``, with the places in ``y`` of the tiles that are
    not beyond the radius; within one slab (``same``) of those from the tile on."""
    uncounted = int(np.searchsorted(y, UNCOUNTED, "right"))
    for a, n in zip(*(v.tolist() for v in tiles_of(np.zeros(len(x), np.int64), x, tile))):
        if x[a] == UNCOUNTED:
            first, end = 0, len(y)
        else:
            first, end = np.searchsorted(y, x[a] - radius), np.searchsorted(y, x[a] + radius, "right")
        if same:
            yield a, a + n, np.arange(a, end)
        else:
            yield a, a + n, np.concatenate([np.arange(min(uncounted, first)), np.arange(first, end)])


def tile_pairs(x: Side, y: Side, similarity: float, tile: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of points of different label between two slabs, or within one, that may be similar."""
    radius = reach(similarity)
    # J >= t means that at least t / (1 + t) of both sizes together is shared.
    share = similarity / (1 + similarity)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, places in near_tiles(x.ones, y.ones, radius, tile, same):
        if not len(places):
            continue
        apart = np.bitwise_count(x.prints[a:b, None, :] ^ y.prints[places][None, :, :]).sum(2, dtype=np.int32)
        sizes, others = x.sizes[a:b, None], y.sizes[places]
        less, more = np.minimum(sizes, others), np.maximum(sizes, others)
        may = (less >= similarity * more - 1e-9) & ((apart <= radius) | (less <= SMALL)) & (x.labels[a:b, None] != y.labels[places])
        may &= np.minimum(x.rests[a:b, None], y.rests[places]) >= share * (sizes + others) - 1e-6
        if same:
            may &= places > np.arange(a, b)[:, None]
        i, j = np.nonzero(may)
        left.append(a + i)
        right.append(places[j])
    i, j = np.concatenate(left), np.concatenate(right)
    only_x, only_y = (np.bitwise_count(a & ~b).sum(1, dtype=np.int64) for a, b in ((x.bits[i], y.bits[j]), (y.bits[j], x.bits[i])))
    near = np.minimum(x.sizes[i] - only_x, y.sizes[j] - only_y) >= share * (x.sizes[i] + y.sizes[j]) - 1e-6
    return i[near], j[near]


def hubs(points: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(a, b), a < b: each point with the closest hub of another label that it may be similar to; one hub a key and turn."""
    keyed = points.select("mark", "print", "ones", "size", "label", F.explode("keys").alias("key"))
    first = F.min_by(F.struct("mark", "print", "ones", "size", "label"), F.xxhash64("mark", F.lit(turn))).alias("hub")
    hub = keyed.groupBy(F.col("key").alias("k")).agg(first, F.min("label").alias("l"), F.max("label").alias("l2")).filter("l <> l2").select("k", "hub")
    rays = keyed.join(hub, F.col("key") == F.col("k")).filter("label <> hub.label").filter(F.least("size", "hub.size") >= similarity * F.greatest("size", "hub.size") - 1e-9)
    rays = rays.filter((F.abs(F.col("ones") - F.col("hub.ones")) <= reach(similarity)) | (F.least("ones", "hub.ones") == UNCOUNTED))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint64).reshape(-1, LANES) for n in ("print", "print2"))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            may = (apart <= reach(similarity)) | (batch.column("less").to_numpy() <= SMALL)
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("mark2"), pa.array(apart)], ["mark", "mark2", "apart"]).filter(pa.array(may))

    rays = rays.select("mark", "print", F.col("hub.mark").alias("mark2"), F.col("hub.print").alias("print2"), F.least("size", "hub.size").alias("less"))
    rays = rays.mapInArrow(lean(near), "mark long, mark2 long, apart long").groupBy("mark").agg(F.min_by("mark2", F.struct("apart", "mark2")).alias("mark2"))
    return rays.select(F.least("mark", "mark2").alias("a"), F.greatest("mark", "mark2").alias("b")).distinct()


def rests(sets: DataFrame, marks: DataFrame) -> DataFrame:
    """(rm, alone, bits): for each of ``marks(mark)`` the number of shingles in ``sets(m, own)`` that no other of them has (null for
    none), and the bitmap of all its shingles."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, own in zip(batch.column("m").to_pylist(), batch.column("own")):
                h = np.frombuffer(own.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), mark)), pa.array(h)], ["m", "h"])

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("own"):
                bits = np.zeros(BITMAP, np.uint8)
                bits[(np.frombuffer(own.as_buffer(), np.uint64) % np.uint64(BITMAP)).astype(np.int64)] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("m"), pa.array(out, pa.binary())], ["rm", "bits"])

    held = stored(sets.join(few(marks), F.col("m") == F.col("mark"), "left_semi"), "sets-in-shared-keys")
    alone = held.mapInArrow(lean(spread), "m long, h long").groupBy("h").agg(F.count("*").alias("c"), F.min("m").alias("am")).filter("c = 1")
    alone = alone.groupBy("am").agg(F.count("*").alias("alone"))
    return stored(held.mapInArrow(lean(bitmaps), "rm long, bits binary").join(alone, F.col("rm") == F.col("am"), "left").drop("am"), "shingle-bounds")


def candidates(points: DataFrame, sets: DataFrame, similarity: float, tile: int) -> DataFrame:
    """(a, b), a < b: marks of all pairs of ``points(mark, print, ones, keys, size, label)`` that share a key, differ in label and may
    be similar."""
    keyed = points.select("mark", "print", "ones", "size", "label", F.explode("keys").alias("key"))
    shared = keyed.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("l"), F.max("label").alias("l2")).filter("l <> l2")
    met = stored(keyed.join(stored(shared.select("k"), "shared-keys"), F.col("key") == F.col("k")).drop("k"), "in-shared-keys")
    # Slabs of neighbouring counts; a count of more points than a tile is dealt further by their marks. A key has 514 counts at most.
    counts = met.groupBy(F.col("key").alias("ck"), F.col("ones").alias("co")).agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("ck").orderBy("co").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy("ck")))
    counts = counts.select("ck", "co", F.floor(F.col("before") / tile).alias("slab"), F.ceil(F.col("m") / tile).alias("parts"), (F.col("n") > tile).alias("large"))
    counts = stored(counts, "slabs")
    alone = rests(sets, stored(met.select("mark").distinct(), "in-shared-keys-marks"))
    met = met.join(alone, F.col("mark") == F.col("rm")).withColumn("rest", F.col("size") - F.coalesce("alone", F.lit(0)))
    met = met.join(few(counts), (F.col("key") == F.col("ck")) & (F.col("ones") == F.col("co")))
    dealt = met.groupBy("key", "large", "slab", F.pmod(F.xxhash64("mark"), F.col("parts")).alias("part"))
    lists = [F.collect_list(n).alias(n if n == "ones" else f"{n}s") for n in ("mark", "ones", "size", "label", "rest")]
    lists += [F.array_join(F.collect_list(F.hex(n)), "").alias(m) for n, m in (("print", "prints"), ("bits", "bitmaps"))]
    lists += [F.min("ones").alias("low"), F.max("ones").alias("high")]
    tiles = stored(dealt.agg(*lists).withColumns({n: F.unhex(n) for n in ("prints", "bitmaps")}), "similar-tiles")

    def found(batches: Iterator[pa.RecordBatch], other: bool) -> Iterator[pa.RecordBatch]:
        def side(batch: pa.RecordBatch, suffix: str, i: int) -> Side:
            marks, ones, sizes, labels, rests = (batch.column(n + suffix)[i].values.to_numpy() for n in ("marks", "ones", "sizes", "labels", "rests"))
            prints, bits = (np.frombuffer(batch.column(n + suffix)[i].as_buffer(), np.uint64).reshape(len(marks), -1) for n in ("prints", "bitmaps"))
            return Side(marks, prints, ones, sizes, labels, rests, bits)

        def made(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros(0, np.int64), *p]) for p in (left, right))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            left, right, held = [], [], 0
            for i in range(batch.num_rows):
                x = side(batch, "", i)
                y = side(batch, "2", i) if other else x
                a, b = tile_pairs(x, y, similarity, tile, not other)
                left.append(x.marks[a])
                right.append(y.marks[b])
                held += len(a)
                if held >= PAIRS:
                    yield made(left, right)
                    left, right, held = [], [], 0
            yield made(left, right)

    names = ["marks", "ones", "sizes", "labels", "rests", "prints", "bitmaps"]
    inside = tiles.select(*names).mapInArrow(lean(lambda batches: found(batches, False)), "a long, b long")
    large = tiles.filter("large")
    second = large.select(F.col("key").alias("key2"), *[F.col(n).alias(n + "2") for n in ("slab", "part", "low", "high", *names)])
    pairs = large.join(second, (F.col("key") == F.col("key2")) & (F.expr("slab < slab2 OR slab = slab2 AND part < part2")))
    pairs = pairs.filter((F.greatest("low", "low2") - F.least("high", "high2") <= reach(similarity)) | (F.least("low", "low2") == UNCOUNTED))
    pairs = pairs.select(*names, *[n + "2" for n in names]).repartition(F.xxhash64("marks", "marks2"))
    return inside.unionByName(pairs.mapInArrow(lean(lambda batches: found(batches, True)), "a long, b long")).distinct()


def few(df: DataFrame) -> DataFrame:
    """For broadcast if its rows, counted, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_MARKS else df


def shingle_sets(points: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(m, own): the shingle set of each of ``points(mark, raw)``, from one of the ``rows(raw, text)`` with its text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # copies of a text are many; a task makes each set once
        for batch in batches:
            marks = batch.column("mark").to_pylist()
            fresh = [i for i, m in enumerate(marks) if not (m in done or done.add(m))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            for a, b in slices(batch, "text"):
                own = [shingle_set(hashed_words(t.lower()), width).tobytes() for t in texts(batch, "text", a, b)]
                yield pa.RecordBatch.from_arrays([batch.column("mark").slice(a, b - a), pa.array(own, pa.binary())], ["m", "own"])

    wanted = few(points.select("mark", F.col("raw").alias("r")))
    found = rows.join(wanted, F.col("raw") == F.col("r")).select("mark", "text").mapInArrow(lean(sets), "m long, own binary")
    return stored(found.groupBy("m").agg(F.first("own").alias("own")), "shingle-sets")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose ``sets(m, own)`` reach the similarity; only sets that occur in a pair travel."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("x"), batch.column("y"))
            near = [jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= similarity - 1e-9 for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    pairs = stored(pairs, "candidates")
    sides = []
    for end, m, x in (("a", "m1", "x"), ("b", "m2", "y")):
        ends = few(stored(pairs.select(F.col(end).alias("e")).distinct(), "ends"))
        sides.append(sets.join(ends, F.col("m") == F.col("e"), "left_semi").select(F.col("m").alias(m), F.col("own").alias(x)))
    full = pairs.join(sides[0], F.col("a") == F.col("m1")).join(sides[1], F.col("b") == F.col("m2")).select("a", "b", "x", "y")
    return stored(full.mapInArrow(lean(check), "a long, b long"), "similar-pairs")


FIRST = "struct<no_id:boolean,doc_id:bigint,raw:bigint>"


def grouped(docs: DataFrame, similarity: float, width: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): ``rows(doc_id, raw, mark)`` for each row of ``docs`` (raw: 64-bit hash of the text), and
    ``groups(mark, first)`` for the marks that have a partner or more than one row: the group's first row, as FIRST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                marks, prints, keys, sizes = zip(*(sized_sketch(t, width) for t in texts(batch, "text", a, b)))
                longs = np.array(marks, np.uint64).view(np.int64)
                ones = np.bitwise_count(np.frombuffer(b"".join(prints), np.uint64).reshape(-1, LANES)).sum(1, dtype=np.int64)
                ones[np.array(sizes) <= SMALL] = UNCOUNTED
                keys = [np.array(k, np.uint64).view(np.int64) for k in keys]
                own = [batch.column(n).slice(a, b - a) for n in ("doc_id", "raw")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(longs), pa.array(prints, pa.binary()), pa.array(ones), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "raw", "mark", "print", "ones", "keys", "size"])

    text_batches(docs.sparkSession)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("raw", F.xxhash64("text"))
    sketches = stored(rows.mapInArrow(lean(run), "doc_id long, raw long, mark long, print binary, ones long, keys array<long>, size long"), "sketches")
    # Aggregates of plain columns are summed before the shuffle, so a text with many copies is a row a task.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw").cast(FIRST)
    points = sketches.groupBy("mark").agg(F.min(first).alias("first"), F.min("raw").alias("raw"), F.count("*").alias("n"), *[F.first(n).alias(n) for n in ("print", "ones", "keys", "size")])
    points = stored(points, "points")
    keyed = points.select("mark", F.explode("keys").alias("key"))
    shared = keyed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c")).filter("c > 1").select("k")
    crowded = keyed.join(shared, F.col("key") == F.col("k"), "left_semi").groupBy(F.col("mark").alias("cm")).agg(F.collect_list("key").alias("keys"))
    crowd = stored(points.select("mark", "raw", "print", "ones", "size").join(stored(crowded, "crowded"), F.col("mark") == F.col("cm")).drop("cm"), "crowd")
    sets = shingle_sets(crowd, rows, width)
    labelled, known = crowd.withColumn("label", F.col("mark")), None

    def linked(pairs: DataFrame) -> DataFrame:
        near = similar_pairs(pairs, sets, similarity)
        return components(near if known is None else near.unionByName(known.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    for turn in range(STARS):
        known = stored(linked(hubs(labelled, similarity, turn)), "known")
        labelled = stored(crowd.join(known, F.col("mark") == F.col("id"), "left").select("mark", "print", "ones", "keys", "size", F.coalesce("component", "mark").alias("label")), "labelled")
    parts = stored(linked(candidates(labelled, sets, similarity, tile)), "parts")
    members = stored(points.select("mark", "first").join(parts, F.col("mark") == F.col("id")).select("mark", "first", "component"), "members")
    # Stored, so that both sides of the join are plain exchanges and adaptive execution can split a large group.
    least = stored(members.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("least")), "least")
    names = stored(members.join(least, F.col("component") == F.col("c")).select(F.col("mark").alias("m"), "least"), "names")
    groups = points.join(names, F.col("mark") == F.col("m"), "left").filter("n > 1 OR least IS NOT NULL")
    return sketches.select("doc_id", "raw", "mark"), stored(groups.select("mark", F.coalesce("least", "first").alias("first")), "groups")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id that a chain of pairs of at least ``similarity`` reaches.

    Similarity is Jaccard over distinct shingles of ``width`` words, exact but for 64-bit hashes of them. Texts of fewer words are
    one shingle. Null texts and texts without words are one group. Repeated rows stay. A row without doc_id takes part, but a
    component's id is the smallest that is not null (null if none has an id). An empty table gives no row.
    """
    rows, groups = grouped(docs, similarity, width, tile)
    names = groups.select(F.col("mark").alias("m"), "first")
    return rows.join(names, F.col("mark") == F.col("m"), "left").select("doc_id", F.when(F.col("m").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def without_copies(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row of ``docs`` for each group of :func:`similar_groups`, with all its columns: that of the smallest doc_id, then of
    the least text hash. Rows without doc_id come last, and one stays if no other is in its group. Rows are told apart by
    doc_id and text, so different texts under one doc_id are different documents. Of rows that agree in both, the one whose
    other columns have the least hash stays.
    """
    rows, groups = grouped(docs, similarity, width, tile)
    held = rows.join(groups.select(F.col("mark").alias("m"), "first"), F.col("mark") == F.col("m"))
    held = held.groupBy("doc_id", "raw").agg(F.first("first").alias("first"), F.count("*").alias("n"))
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("raw") == F.col("first.raw"))
    held = stored(held.select(F.col("doc_id").alias("_g"), F.col("raw").alias("_r"), mine.alias("stays"), "n"), "copies")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_g")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_r"))
    gone, again = held.filter("NOT stays").select("_g", "_r"), held.filter("stays AND n > 1").select("_g", "_r")
    kept = docs.join(few(gone), same, "left_anti")
    if again.isEmpty():
        return kept
    # Equal rows: one of each, summed before the shuffle.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.join(few(again), same).groupBy("_g", "_r").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("_one")).select("_one.*")
    return kept.join(few(again), same, "left_anti").unionByName(one)

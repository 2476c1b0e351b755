"""SimHash near-copies: fingerprints of word shingles, linked exactly at a Hamming radius by tiled comparison.

Equal fingerprints become one point first, so a large group of copies costs one comparison. A tile is a run of at most
``TILE`` points of one population count; a tile pair is one numpy exclusive-or with bit counts, and pairs whose counts differ
by more than the radius are skipped. Tiles are cut within keys: a fingerprint has radius + 2 blocks of bits, so two within the
radius agree in at least two blocks, and each choice of two blocks is a key (six keys of 32 bits for radius 2; a key of
10^10 even points has two or three). Keys with more than ``SPLIT`` points are dealt as tile pairs over many tasks; their work
still grows with the square of the points that share a key and nearly a population count. A tile pair with many
links hands on at most one for each point (the spanning forest of what it found), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import lean, only, slices, stored, text_batches, texts, word_pieces
from vecloom.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
TILE = 256
#: Points of one key that a single task may hold.
SPLIT = 4096
#: Comparisons that are made at a time.
AT_ONCE = 1 << 20
#: Tile pairs of more comparisons hand on a spanning forest.
DENSE = 1024


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is 1 if it is set in over half the shingle hashes; no word: 0. Words are split at ASCII white space, A-Z lowered."""
    digest = xxhash.xxh64_intdigest
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for piece in word_pieces(text.lower()):
        words = tail + piece
        if len(words) < width:
            tail = words
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)
        for at in range(0, len(h), 65536):
            counts += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
        tail = words[len(words) - width + 1 :]
    if not total:
        return digest(b" ".join(tail), seed) if tail else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                fps = np.array([fingerprint(x, width, seed) for x in texts(batch, "text", a, b)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(fps)], ["doc_id", "fp"])

    text_batches(docs.sparkSession)
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


class Forest:
    """Union-find over positions; keeps a link only if it joins two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def add(self, ii: np.ndarray, jj: np.ndarray) -> None:
        for i, j in zip(ii.tolist(), jj.tolist()):
            a, b = self.find(i), self.find(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.links.append((i, j))


def tiles_of(key: np.ndarray, ones: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the tiles of points in order of key, then population count."""
    n = len(key)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (ones[1:] != ones[:-1]))) if n else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    starts = np.flatnonzero(place % tile == 0)
    return starts, np.diff(np.append(starts, n))


def near_tiles(key: np.ndarray, ones: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of tiles (a <= b) of one key whose population counts differ by the radius at most."""
    a = np.arange(len(starts))
    key, ones = key[starts], ones[starts]
    step = 0
    while len(a):
        a = a[a + step < len(starts)]
        b = a + step
        a = a[(key[a] == key[b]) & (ones[b] - ones[a] <= radius)]  # tiles are in order: all later ones are farther
        if len(a):
            yield a, a + step
        step += 1


def compared(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j), i < j, as positions. Tile pairs of one shape are stacked and compared in one numpy call."""
    shape = sizes[a] * (1 << 20) + sizes[b]
    order = np.argsort(shape, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], shape[order][1:] != shape[order][:-1])))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        n, m = int(sizes[a[order[lo]]]), int(sizes[b[order[lo]]])
        step = max(1, AT_ONCE // (n * m))
        for at in range(lo, hi, step):
            own = order[at : min(at + step, hi)]
            s, t = starts[a[own]], starts[b[own]]
            k, i, j = np.nonzero(np.bitwise_count(fp[s[:, None] + np.arange(n)][:, :, None] ^ fp[t[:, None] + np.arange(m)][:, None, :]) <= radius)
            i, j = s[k] + i, t[k] + j
            keep = i < j
            i, j = i[keep], j[keep]
            if n * m > DENSE and len(i):
                points, both = np.unique(np.concatenate([i, j]), return_inverse=True)
                forest = Forest(len(points))
                forest.add(both[: len(i)], both[len(i) :])
                i, j = (points[np.array(x, np.int64)] for x in zip(*forest.links))
            yield i, j


def tile_links(fp: np.ndarray, key: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of fingerprints that share a key, from points in any order."""
    ones = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((ones, key))
    fp, key, ones = fp[order], key[order], ones[order]
    starts, sizes = tiles_of(key, ones, tile)
    found = [(fp[i], fp[j]) for a, b in near_tiles(key, ones, starts, radius) for i, j in compared(fp, starts, sizes, a, b, radius)]
    return tuple(np.concatenate([np.zeros(0, np.uint64), *(f[side] for f in found)]) for side in (0, 1))


def block_keys(fp, radius: int) -> list:
    """Columns with the bits of each choice of two of radius + 2 blocks."""
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]
    return [F.shiftleft(part[i], cuts[j + 1] - cuts[j]).bitwiseOR(part[j]) for i, j in combinations(range(blocks), 2)]


def links(points: DataFrame, radius: int = RADIUS, split: int = SPLIT, tile: int = TILE) -> DataFrame:
    """(a, b) fingerprints whose closure is that of all pairs within ``radius``; ``points(fp)`` are distinct."""
    keyed = points.select("fp", F.posexplode(F.array(*block_keys(F.col("fp"), radius))).alias("band", "value"))
    sizes = keyed.groupBy("band", "value").agg(F.count("*").alias("n")).filter(F.col("n") > split)
    hot = stored(sizes.select(F.col("band").alias("hb"), F.col("value").alias("hv"), "n"), "hot-keys")
    n_hot = hot.count()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)

        def emit(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            key = np.cumsum(np.concatenate(([True], (k[1:] != k[:-1]).any(1))))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in tile_links(f, key, radius, tile)], ["a", "b"])

        for batch in batches:
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "value")], 1)
            k = np.concatenate([rest_k, k])
            f = np.concatenate([rest_f, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(k):
                continue
            last = int(np.flatnonzero((k == k[-1]).all(1))[0])  # the last key may go on in the next batch
            if last:
                yield emit(k[:last], f[:last])
            rest_k, rest_f = k[last:], f[last:]
        if len(rest_k):
            yield emit(rest_k, rest_f)

    common = keyed.join(hot, (F.col("band") == F.col("hb")) & (F.col("value") == F.col("hv")), "left_anti") if n_hot else keyed
    found = common.repartition("band", "value").sortWithinPartitions("band", "value").mapInArrow(lean(near), "a long, b long")
    if not n_hot:
        return found
    # Keys with many points: tiles of one population count each, compared with tiles up to `radius` counts away.
    here = keyed.join(hot, (F.col("band") == F.col("hb")) & (F.col("value") == F.col("hv"))).withColumn("ones", F.bit_count("fp"))
    by_count = here.groupBy("band", "value", "ones").agg(F.count("*").alias("m"))
    by_count = stored(by_count.select(F.col("band").alias("cb"), F.col("value").alias("cv"), F.col("ones").alias("co"), F.ceil(F.col("m") / tile).alias("parts")), "hot-counts")
    dealt = here.join(by_count, (F.col("band") == F.col("cb")) & (F.col("value") == F.col("cv")) & (F.col("ones") == F.col("co")))
    dealt = dealt.groupBy("band", "value", "ones", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part")).agg(F.collect_list("fp").alias("fps"))
    tiles = stored(dealt, "tiles")
    other = tiles.select(F.col("band").alias("b2"), F.col("value").alias("v2"), F.explode(F.array(*[F.col("ones") - i for i in range(radius + 1)])).alias("o2"), F.col("ones").alias("ones2"), F.col("part").alias("part2"), F.col("fps").alias("fps2"))
    pairs = tiles.join(other, (F.col("band") == F.col("b2")) & (F.col("value") == F.col("v2")) & (F.col("ones") == F.col("o2")))
    pairs = pairs.filter((F.col("ones") < F.col("ones2")) | (F.col("part") <= F.col("part2"))).select("fps", "fps2").repartition(F.xxhash64("fps", "fps2"))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("fps"), batch.column("fps2")):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (one, two))
                both, start, size = np.concatenate([x, y]), np.array([0, len(x)]), np.array([len(x), len(y)])
                for i, j in compared(both, start, size, np.array([0]), np.array([1]), radius):
                    yield pa.RecordBatch.from_arrays([pa.array(both[i].view(np.int64)), pa.array(both[j].view(np.int64))], ["a", "b"])

    return found.unionByName(pairs.mapInArrow(lean(tiled), "a long, b long"))


def near_copies(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that a chain of links at ``radius`` bits or fewer reaches.

    Documents without words have fingerprint 0 and are linked like others. Repeated rows stay. A row without doc_id keeps
    its fingerprint and links, but a component's id is the smallest that is not null (null if none has an id).
    """
    prints = stored(fingerprints(docs, width, seed), "prints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    parts = components(links(points.select("fp"), radius))
    # Components are found over fingerprints; each takes the smallest doc_id of its points. Tables are stored, so that the
    # joins have plain exchanges on both sides and adaptive execution can split a large component or a common fingerprint.
    linked = stored(points.join(parts, F.col("fp") == F.col("id")).select("fp", "first_id", "component"), "linked")
    least = stored(linked.groupBy(F.col("component").alias("c")).agg(F.min("first_id").alias("least")), "least")
    named = linked.join(least, F.col("component") == F.col("c")).select(F.col("fp").alias("_fp"), F.col("least").alias("component_id"))
    alone = points.join(linked.select(F.col("fp").alias("l")), F.col("fp") == F.col("l"), "left_anti")
    names = stored(named.unionByName(alone.select(F.col("fp").alias("_fp"), F.col("first_id").alias("component_id"))), "names")
    return prints.join(names, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_copies(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Exact top-k inner-product search with two cover trees, one over queries and one over data.

A node at level l covers its points within 2^l around its centre point, its children cover theirs within 2^(l-1), and the
children's centres are more than 2^(l-1) apart. For a query node Q and a data node R the score of any pair is at most
``cq.cr + rq*|cr| + rr*|cq| + rq*rr``; the pair of nodes is pruned when that is below the worst k-th score that any query in Q
holds so far. Equal vectors share one point, so a vector that is very common costs one comparison; a point carries its
smallest ids, as many as a query can need.

Scale: data are dealt once to shards around pivots, and each shard's trees are built once and stored. A query first searches
the shard whose centre scores best, which gives it a k-th score; then it goes only to the shards whose root bound reaches
that score. Queries travel to shards, never data to queries: a task loads one shard's trees and streams queries past them.
What is shuffled is the data once, and queries times the shards that may matter.
"""

from __future__ import annotations

import pickle
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.common import lean, only, stored, trim

#: Points of a leaf, of one tree, and of a shard (16 MB for 64 components of 16 bits).
LEAF = 64
TREE = 4096
SHARD = 1 << 17
#: Shards of a small table, for its tasks' sake; and of any table before shards are split by hash.
FEWEST, MOST = 12, 1 << 14
#: Roots of shards up to this many are sent to executors to route queries (8 bytes a component); with more, queries go to all shards.
ROOTS = 1 << 16
QUERY_BLOCK = 1024
#: Components are below this after scaling; a larger one is an error.
BOUND = float(1 << 62)


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    norm: float
    level: int | None = None
    children: list["Node"] = field(default_factory=list)
    worst: float = -np.inf


def build(x: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """Cover tree over the distinct points ``x[rows]``. Children's centres are taken farthest first until they cover the
    node within half its scale, so they are farther than that from each other. Children of one point are kept together in a
    node without children, around their parent's centre."""
    square = np.einsum("ij,ij->i", x, x)

    def distance(rows: np.ndarray, c: int) -> np.ndarray:
        """Upper bounds of distances, exact but for rounding."""
        d = square[rows] + square[c] - 2 * (x[rows] @ x[c])
        return np.where(rows == c, 0.0, np.sqrt(np.maximum(d, 0) + 1e-9 * (square[rows] + square[c])))

    def node(rows: np.ndarray, centre: int, dist: np.ndarray) -> Node:
        radius = float(dist.max())
        made = Node(rows, x[centre], radius, float(np.sqrt(square[centre])))
        if len(rows) <= leaf or radius == 0:
            return made
        level = int(np.ceil(np.log2(radius)))
        scale = 2.0 ** (level - 1)
        near, owner, centres = dist.copy(), np.zeros(len(rows), np.int64), [centre]
        while near[far := int(near.argmax())] > scale:
            d = distance(rows, int(rows[far]))
            closer = d < near
            near[closer], owner[closer] = d[closer], len(centres)
            centres.append(int(rows[far]))
        if len(centres) == 1:  # points so close that rounding hides their order
            return made
        made.level = level
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        single = []
        for k, c in enumerate(centres):
            own = order[cuts[k] : cuts[k + 1]]
            if len(own) > 1:
                made.children.append(node(rows[own], c, near[own]))
            elif len(own):
                single.append(int(own[0]))
        if single:
            made.children.append(Node(rows[single], made.centre, float(dist[single].max()), made.norm))
        return made

    root = int(rows[0])
    return node(rows, root, distance(rows, root))


def forest(x: np.ndarray, size: int = TREE) -> list[Node]:
    """Trees of at most ``size`` points, each of neighbours: points are halved between two far ones until they fit."""
    trees, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            trees.append(build(x, rows))
            continue
        a = x[rows[((x[rows] - x[rows[0]]) ** 2).sum(1).argmax()]]
        b = x[rows[((x[rows] - a) ** 2).sum(1).argmax()]]
        along = x[rows] @ (b - a)
        order = np.argsort(along, kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return trees


def slack(a, b):
    """What rounding can change in a bound of inner products of vectors of these lengths."""
    return 1e-9 * (a * b) + 1e-6


class Search:
    """Best k (score, id) of each query point among the data that it is shown; bounds keep improving.

    ``floors``: scores that the k-th best of a query is known to reach. Scores are exact: by floats while no partial sum can
    pass 2^53, else by 64-bit integers while none can pass 2^62, else by Python's.
    """

    def __init__(self, x: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.x, self.k = x, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(len(x))]
        self.kth = np.full(len(x), -np.inf) if floors is None else floors.astype(np.float64)
        self.xf = x.astype(np.float64)
        self.trees = forest(self.xf)
        for t in self.trees:
            self.settle(t)

    def settle(self, q: Node) -> None:
        for c in q.children:
            self.settle(c)
        q.worst = float(self.kth[q.rows].min())

    def add(self, y: np.ndarray, ids: list[list[int]], trees: list[Node] | None = None, yf: np.ndarray | None = None) -> None:
        self.y, self.ids = y, ids
        self.yf = y.astype(np.float64) if yf is None else yf
        most = int(max(abs(int(self.x.max(initial=0))), abs(int(self.x.min(initial=0))))) * int(max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))) * max(1, y.shape[1])
        self.wide = 0 if most < 2**53 else 1 if most < 2**62 else 2
        for q in self.trees:
            self.visit(q, forest(self.yf) if trees is None else trees)

    def visit(self, q: Node, data: list[Node]) -> None:
        """Compare q with the data nodes, best bound first; expand the data side until leaves, then the query side."""
        while True:
            if not data:
                return
            c = np.array([r.centre for r in data])
            radius, norm = np.array([r.radius for r in data]), np.array([r.norm for r in data])
            bound = c @ q.centre + q.radius * norm + radius * q.norm + q.radius * radius
            bound += slack(q.norm + q.radius, norm + radius)
            keep = np.flatnonzero(bound >= q.worst)
            data = [data[i] for i in keep[np.argsort(-bound[keep], kind="stable")]]
            wide = [r for r in data if r.children and (r.radius > q.radius or not q.children)]
            if not wide:
                break
            wide_ids = set(map(id, wide))
            data = [c for r in data for c in (r.children if id(r) in wide_ids else [r])]
        if q.children:
            for child in q.children:
                self.visit(child, data)
            q.worst = min(c.worst for c in q.children)
            return
        for r in data:
            bound = float(r.centre @ q.centre + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius)
            if bound + slack(q.norm + q.radius, r.norm + r.radius) >= q.worst:
                self.compare(q, r)

    def scores(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        if self.wide == 0:
            return self.xf[q] @ self.yf[r].T
        if self.wide == 1:
            return self.x[q] @ self.y[r].T
        return self.x[q].astype(object) @ self.y[r].astype(object).T

    def compare(self, q: Node, r: Node) -> None:
        scores = self.scores(q.rows, r.rows)
        # The k-th scores are floats here, so a score near one may pass; the lists below are exact.
        hit = scores.astype(np.float64) >= (self.kth[q.rows] - 1e-9 * np.abs(np.where(np.isinf(self.kth[q.rows]), 0, self.kth[q.rows])))[:, None]
        if not hit.any():
            return
        for a in np.flatnonzero(hit.any(1)):
            i = int(q.rows[a])
            best, s = self.best[i], scores[a]
            cand = np.flatnonzero(hit[a])
            for b in sorted(cand, key=lambda b: -s[b]) if self.wide else cand[np.argsort(-s[cand], kind="stable")]:
                score = int(s[b])
                if len(best) >= self.k and score < -best[self.k - 1][0]:
                    break
                for vec_id in self.ids[r.rows[b]]:
                    insort(best, (-score, vec_id))
                del best[self.k :]
            if len(best) >= self.k:
                self.kth[i] = max(self.kth[i], float(-best[-1][0]))
        q.worst = float(self.kth[q.rows].min())


def integer_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): components floor(256 * x) as longs. Vectors that are null or hold a null or non-finite component are left
    out, as are rows without an id; a component that would pass 62 bits is an error."""
    x = F.col(f"`{vec_col}`")
    ok = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.col(f"`{id_col}`").isNotNull()
    scaled = lambda e: e.cast("double") * 256
    whole = F.transform(x, lambda e: F.when(F.abs(scaled(e)) < BOUND, F.floor(scaled(e))).otherwise(F.raise_error(F.lit("a component passes 62 bits")).cast("long")))
    return only(table, id_col, vec_col).filter(F.coalesce(ok, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("v"))


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    """Lists as rows, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy().astype(np.int64)
    if (sizes == wide).all():
        return values.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    for i, (a, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
        out[i, :n] = values[a : a + n]
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The smallest integers that hold the values."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def shipped(t: Node) -> tuple:
    """A tree without its centres' components, to be stored."""
    return t.rows.astype(np.int32), t.centre, t.radius, t.norm, t.level, [shipped(c) for c in t.children]


def landed(t: tuple) -> Node:
    return Node(t[0], t[1], t[2], t[3], t[4], [landed(c) for c in t[5]])


def indexed(points: DataFrame, wide: int, shard: int) -> DataFrame:
    """(shard, pivot, centre, radius, trees): the stored trees of each shard of ``points(id, h, ids, v)``."""
    n = points.count()
    number = min(max(FEWEST, -(-n // shard)), MOST, max(n, 1))
    sample = points.select("v").orderBy(F.xxhash64("id", "h", F.lit(1)), "id", "h").limit(number).toArrow().column("v").combine_chunks()
    pivots = matrix(sample, wide).astype(np.float64)
    square = (pivots**2).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), wide).astype(np.float64)
            near = np.concatenate([(square - 2 * (x[a : a + 2048] @ pivots.T)).argmin(1) for a in range(0, len(x), 2048)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int64))], [*batch.schema.names, "pivot"])

    near = stored(points.select("id", "h", "ids", "v").mapInArrow(lean(assign), "id long, h long, ids array<long>, v array<long>, pivot long"), "near-pivots")
    # At most MOST rows: a pivot with many points is several shards.
    parts = F.broadcast(near.groupBy(F.col("pivot").alias("p")).agg(F.ceil(F.count("*") / F.lit(float(shard))).cast("long").alias("parts")))
    dealt = near.join(parts, F.col("pivot") == F.col("p")).withColumn("shard", F.col("pivot") * (1 << 20) + F.pmod(F.xxhash64("id", "h", F.lit(2)), F.col("parts")))

    def grow(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = matrix(table.column("v").chunk(0), wide)
        xf = x.astype(np.float64)
        centre = xf.mean(0)
        radius = float(np.sqrt(((xf - centre) ** 2).sum(1).max()))
        body = pickle.dumps((narrow(x), table.column("ids").to_pylist(), [shipped(t) for t in forest(xf)]), 5)
        out = [[table.column(c)[0].as_py()] for c in ("shard", "pivot")]
        trim()
        return pa.table([pa.array(c) for c in (*out, [centre.tolist()], [radius], [body])], ["shard", "pivot", "centre", "radius", "trees"])

    grown = dealt.select("shard", "pivot", "ids", "v").groupBy("shard").applyInArrow(grow, "shard long, pivot long, centre array<double>, radius double, trees binary")
    return stored(grown, "cover-trees")


def searched(routed: DataFrame, index: DataFrame, shards: int, wide: int, need: int, block: int) -> DataFrame:
    """(id, h, score, vec_id): the best ``need`` of each of ``routed(shard, id, h, v, floor)`` within its shard, if they reach the floor."""
    names = ["shard", "kind", "id", "h", "v", "floor", "trees"]
    none = lambda kind: F.lit(None).cast(kind)
    left = index.select("shard", F.lit(0).alias("kind"), none("long").alias("id"), none("long").alias("h"), none("array<long>").alias("v"), none("double").alias("floor"), "trees")
    right = routed.select("shard", F.lit(1).alias("kind"), "id", "h", "v", "floor", none("binary").alias("trees"))
    rows = left.unionByName(right).repartition(max(1, shards), "shard").sortWithinPartitions("shard", "kind").select(*names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def found(part: pa.RecordBatch) -> pa.RecordBatch:
            y, yf, ids, trees = held
            s = Search(matrix(part.column("v"), wide), need, part.column("floor").to_numpy(zero_copy_only=False))
            s.add(y, ids, trees, yf)
            point = list(zip(part.column("id").to_pylist(), part.column("h").to_pylist()))
            rows = [(*point[i], -score, vec_id) for i, best in enumerate(s.best) for score, vec_id in best]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, ["id", "h", "score", "vec_id"])

        for batch in batches:
            kinds, shard = (batch.column(c).to_numpy() for c in ("kind", "shard"))
            cuts = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (kinds[1:] != kinds[:-1])))) if len(shard) else []
            for a, b in zip(cuts, [*cuts[1:], len(shard)]):
                if kinds[a] == 0:
                    x, ids, trees = pickle.loads(batch.column("trees")[a].as_buffer())
                    x = x.astype(np.int64)
                    held = x, x.astype(np.float64), ids, [landed(t) for t in trees]
                    continue
                for i in range(a, b, block):
                    yield found(batch.slice(i, min(block, b - i)))

    return rows.mapInArrow(lean(search), "id long, h long, score long, vec_id long")


def top_k(vectors: DataFrame, is_query, k: int = 5, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors(vec_id, v)`` that meets ``is_query`` its k best others.

    Ties go to the smaller vec_id. Equal rows count once; rows of one vec_id with different vectors are rows of their own (as
    queries they are ranked together under their id); a row is never a result of its own vec_id. Vectors shorter than
    another count as padded with zeros. A score that passes 64 bits is an error. No query or no other row: no result rows.
    """
    base = stored(vectors.select("vec_id", "v").distinct(), "vectors")
    # Rows of the query's own id take places that are not counted.
    need = k + (base.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1)
    # At most so many ids of a vector can matter; Spark limits each group before the shuffle, so a common vector stays small.
    by_vec = Window.partitionBy("v").orderBy("vec_id")
    points = base.withColumn("rn", F.row_number().over(by_vec)).filter(F.col("rn") <= need).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = stored(points.withColumn("id", F.col("ids")[0]).withColumn("h", F.xxhash64("v")), "points")
    wanted = base.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    queries = stored(wanted.join(points.select("v", "id", "h"), F.col("qv") == F.col("v")).select("query_id", "id", "h", "v"), "queries")
    asked = queries.groupBy("id", "h").agg(F.first("v").alias("v"))
    wide = points.agg(F.max(F.size("v"))).first()[0] or 0
    index = indexed(points, wide, shard)
    roots = index.select("shard", "pivot").orderBy("shard").toArrow()
    ids, shards = roots.column("shard").to_numpy(), roots.num_rows
    centre = radius = norm = np.zeros((0, wide))
    home_of: dict[int, list[int]] = {}
    if 0 < shards <= ROOTS:
        table = index.select("shard", "centre", "radius").orderBy("shard").toArrow()
        centre = np.array(table.column("centre").to_pylist(), np.float64).reshape(shards, wide)
        radius, norm = table.column("radius").to_numpy(), np.sqrt((centre**2).sum(1))
        for i, p in enumerate(roots.column("pivot").to_pylist()):
            home_of.setdefault(p, []).append(i)
    parts = list(home_of.values())
    firsts = np.array([own[0] for own in parts], np.int64)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shard whose centre scores best; of one pivot's shards any."""
        for batch in batches:
            q = matrix(batch.column("v"), wide).astype(np.float64)
            pick = np.concatenate([np.zeros(0, np.int64), *((q[a : a + 1024] @ centre[firsts].T).argmax(1) for a in range(0, len(q), 1024))])
            home = [int(ids[parts[p][h % len(parts[p])]]) for p, h in zip(pick.tolist(), batch.column("h").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), *(batch.column(c) for c in ("id", "h", "v"))], ["shard", "id", "h", "v"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All other shards whose root bound reaches the query's floor; all of them if there are too many roots."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                may = np.ones((part.num_rows, shards), bool)
                if len(centre):
                    q = matrix(part.column("v"), wide).astype(np.float64)
                    size = np.sqrt((q**2).sum(1))[:, None]
                    may = q @ centre.T + size * radius + slack(size, norm + radius) >= part.column("floor").to_numpy(zero_copy_only=False)[:, None]
                    may[np.arange(len(q)), np.searchsorted(ids, part.column("home").to_numpy())] = False
                i, s = np.nonzero(may)
                for a in range(0, len(i), 4096):
                    own = part.take(pa.array(i[a : a + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s[a : a + 4096]]), *(own.column(c) for c in ("id", "h", "v", "floor"))], ["shard", "id", "h", "v", "floor"])

    routed = "shard long, id long, h long, v array<long>, floor double"
    lowest, found = F.lit(float("-inf")), []
    if len(centre):
        asked = stored(asked.mapInArrow(lean(homes), "shard long, id long, h long, v array<long>"), "asked").withColumnRenamed("shard", "home")
        near = searched(asked.withColumn("floor", lowest).withColumnRenamed("home", "shard"), index, shards, wide, need, query_block)
        found.append(stored(near, "found-near"))
        reached = found[0].groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
        asked = asked.join(reached, (F.col("id") == F.col("i")) & (F.col("h") == F.col("g")), "left")
        # A long as a float may lie above itself by rounding; the floor keeps clear of that.
        clear = F.col("least").cast("double") - 1e-9 * F.abs(F.col("least").cast("double"))
        asked = asked.select("home", "id", "h", "v", F.when(F.col("n") >= need, clear).otherwise(lowest).alias("floor"))
    else:
        asked = asked.select(F.lit(0).cast("long").alias("home"), "id", "h", "v", lowest.alias("floor"))
    found.append(searched(asked.mapInArrow(lean(others), routed), index, shards, wide, need, query_block))
    found = stored(found[0].unionByName(found[1]) if len(found) == 2 else found[0], "found")
    order = [F.col("score").desc(), F.col("vec_id")]
    best = found.withColumn("rn", F.row_number().over(Window.partitionBy("id", "h").orderBy(*order))).filter(F.col("rn") <= need)
    best = best.select(F.col("id").alias("i"), F.col("h").alias("g"), "score", "vec_id")
    both = queries.select("query_id", "id", "h").join(best, (F.col("id") == F.col("i")) & (F.col("h") == F.col("g"))).filter("query_id <> vec_id")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two joins on vertex ids; the minimum of a vertex is a partial aggregate and the join back has plain
exchanges on both sides, so adaptive execution splits the links of a hub. Rounds are stored in the shared folder, and
their number grows with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import discard, stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """A round over stored ``edges(a, b)``, which are deleted after it. Large: link a vertex's larger neighbours to its least
    neighbour; small: the smaller ones and itself."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = near.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = stored(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("x"), "m"), "least")
    pairs = near.join(least, F.col("u") == F.col("x"))
    if large:
        out = pairs.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = pairs.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("x").alias("a"), F.col("m").alias("b")))
    done = stored(out.filter("a <> b").distinct(), "large" if large else "small")
    discard(least, edges)
    return done


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id that has a link in ``edges(a, b)``. Loops and repeats are allowed."""
    edges = stored(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == mark:
            break
        mark = now
        edges = star(star(edges, True), False)
    own = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(own)

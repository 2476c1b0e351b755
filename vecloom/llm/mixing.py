"""Mixing sources to target word weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source wants the same number of copies, target / source size. The whole part is fixed; the fraction is
rounded so that the source's words are kept: two documents exchange word mass, in a random direction, until the fraction
of one is 0 or 1, and the other meets the next. Moves are balanced, so each document keeps its expected copies. Blocks of
about ``BLOCK`` documents reduce to one undecided document each, those form the next level's blocks, and so on: a tree of
depth log(n) whose tasks hold one block, whatever a source's share of the rows. The last one of a source is decided by its
fraction, so a source's taken words differ from its target by at most one document, a short one as a rule since a block
goes from long to short. Random numbers are hashes of ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.common import joined, keyed, only, stored, word_count

WEIGHTS = (5, 2, 1)
#: Words a source may give at most, in its own size.
MOST = 3
BLOCK = 64
SEED = 17
#: Sources up to this many are broadcast (some hundred bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: Parts in which rows of one id, source and size are numbered.
PARTS = 1024


def random(*parts: Column) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts, F.lit(SEED)), 11) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) for ``sizes(source, size)``: shares by weight of all words, stopped at ``most`` times a source's size.

    A source is stopped if the level of those not yet stopped exceeds its own; in order of size per weight, those that
    stop come first, so one running sum gives the fixed point of resharing. The window runs over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    scale = 1
    for w in weights:
        scale *= w
    big = "decimal(38,0)"
    t = by_source.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(place - 1, F.lit(len(weights))).cast("int") + 1))
    t = t.withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy((F.col("cap") * (F.lit(scale) / F.col("w")).cast("long")).cast(big), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    t = t.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("stopped", (F.col("w") * F.col("left")).cast(big) > (F.col("cap").cast(big) * F.col("left_w")))
    t = t.withColumn("free", F.col("total") - F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(every))
    t = t.withColumn("free_w", F.col("all_w") - F.sum(F.when(F.col("stopped"), F.col("w")).otherwise(0)).over(every))
    share = F.col("w").cast("double") * F.col("free").cast("double") / F.col("free_w").cast("double")
    return t.select("source", "source_size", "n", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def meet(state: Column, other: Column, level: int) -> Column:
    """Let the undecided document of ``state`` exchange mass with ``other``; one of them is decided and goes to ``out``."""
    one = state["cur"]
    up, down = one["size"] * (1 - one["p"]), one["size"] * one["p"]
    up2, down2 = other["size"] * (1 - other["p"]), other["size"] * other["p"]
    gain, loss = F.least(up, down2), F.least(down, up2)
    rise = random(one["id"], one["copy"], other["id"], other["copy"], F.lit(level)) * (gain + loss) < loss
    rise = rise | ((gain + loss) == 0)
    first_done = F.when(rise, up <= down2).otherwise(down <= up2)

    def unit(u: Column, p: Column) -> Column:
        return F.struct(u["size"].alias("size"), u["id"].alias("id"), u["copy"].alias("copy"), u["base"].alias("base"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    move = F.when(rise, gain).otherwise(-loss)
    kept = F.when(first_done, unit(other, other["p"] - move / other["size"])).otherwise(unit(one, one["p"] + move / one["size"]))
    done = F.when(first_done, unit(one, F.when(rise, 1.0).otherwise(0.0))).otherwise(unit(other, F.when(rise, 0.0).otherwise(1.0)))
    return F.struct(kept.alias("cur"), F.array_append(state["out"], done).alias("out"))


UNIT = "struct<size:bigint,id:bigint,copy:bigint,base:bigint,p:double>"


def rounded(units: DataFrame, blocks_of: DataFrame, largest: int, n_sources: int, block: int = BLOCK) -> DataFrame:
    """(source, id, copy, size, copies) for ``units(source, id, copy, size, base, p)`` with 0 < p < 1 and size > 0."""
    decided = None
    level, most, span = 0, largest, block
    while True:
        count = F.ceil(F.col("n") / F.lit(float(span))).cast("long")
        dealt = joined(units, keyed(blocks_of.select("source", count.alias("blocks")), "source"), ["source"], "inner", BROADCAST_SOURCES, n_sources)
        group = F.pmod(F.xxhash64("id", "copy", F.lit(level), F.lit(SEED)), F.col("blocks"))
        member = F.struct("size", "id", "copy", "base", "p").cast(UNIT)
        folded = dealt.groupBy("source", group.alias("block")).agg(F.sort_array(F.collect_list(member), asc=False).alias("m"))
        start = F.struct(F.col("m")[0].alias("cur"), F.array().cast(f"array<{UNIT}>").alias("out"))
        folded = folded.select("source", F.aggregate(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), start.cast(f"struct<cur:{UNIT},out:array<{UNIT}>>"), lambda s, o: meet(s, o, level).cast(f"struct<cur:{UNIT},out:array<{UNIT}>>")).alias("s"))
        folded = stored(folded, f"level{level}")
        part = folded.select("source", F.explode("s.out").alias("u")).select("source", "u.*")
        decided = part if decided is None else decided.unionByName(part)
        units = folded.select("source", "s.cur.*")
        if most <= span:
            break
        level, span = level + 1, span * block
    last = units.withColumn("p", F.when(random(F.col("id"), F.col("copy"), F.lit(-1)) < F.col("p"), 1.0).otherwise(0.0))
    return decided.unionByName(last).select("source", "id", "copy", "size", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per row of ``docs(doc_id, text, source)``.

    size: words of the text (null: 0). A document without words draws its copies by itself, as it moves no words. Repeated
    rows are separate documents. Null is a source of its own, the last; a null doc_id is an id like others. An empty table
    gives no row; if no document has words, every target is 0.
    """
    sizes = stored(only(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    goals = stored(targets(sizes, weights, most), "targets")
    n_sources, largest = goals.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    # Rows that are alike are numbered, so that many repeats of one id do not meet in one block.
    rows = sizes.groupBy("source", "id", "size").agg(F.count("*").alias("m")).select("source", "id", "size", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("copy"))
    rows = joined(rows, keyed(goals.drop("n"), "source"), ["source"], "inner", BROADCAST_SOURCES, n_sources)
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(want).cast("long")).withColumn("p", want - F.floor(want))
    rows = stored(rows, "units")
    free = rows.filter("size > 0 AND p > 0").select("source", "id", "copy", "size", "base", "p")
    done = rounded(free, goals.select("source", "n"), largest, n_sources, block)
    drawn = F.when(random(F.col("id"), F.col("copy"), F.lit(-2)) < F.col("p"), 1).otherwise(0)
    fixed = rows.filter("size = 0 OR p = 0").select("source", "id", "copy", "size", (F.col("base") + drawn).cast("long").alias("copies"))
    every = done.unionByName(fixed)
    every = joined(every, keyed(goals.drop("n"), "source"), ["source"], "inner", BROADCAST_SOURCES, n_sources)
    return every.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", "copy")


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``_at``: 1, 2, ... among the rows of equal (d, s, n). Rows without id may be many under one key, so they are counted by
    parts of text hashes first and numbered inside a part; only equal texts are surely in one part."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc.text"), F.lit(PARTS)))
    counts = rows.groupBy(F.col("d").alias("_d"), F.col("s").alias("_s"), F.col("n").alias("_n"), F.col("_part").alias("_p")).agg(F.count("*").alias("c"))
    before = Window.partitionBy("_d", "_s", "_n").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("_before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c"), "numbers")
    inside = rows.withColumn("_own", F.row_number().over(Window.partitionBy("d", "s", "n", "_part").orderBy(F.xxhash64("doc.text"))))
    same = F.col("d").eqNullSafe(F.col("_d")) & F.col("s").eqNullSafe(F.col("_s")) & (F.col("n") == F.col("_n")) & (F.col("_part") == F.col("_p"))
    return inside.join(counts, same).withColumn("_at", F.col("_before") + F.col("_own")).select("doc", "d", "s", "n", "_at")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` says; columns stay."""
    plan = stored(mix(docs).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copy").alias("_copy"), F.col("copies").alias("_copies")), "copies")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("d"), F.col("source").cast("string").alias("s"), word_count(F.col("text")).alias("n"))
    same = F.col("d").eqNullSafe(F.col("_id")) & F.col("s").eqNullSafe(F.col("_source")) & (F.col("n") == F.col("_size"))
    if plan.agg(F.max("_copy")).first()[0] not in (None, 1):
        rows = numbered(rows)
        same = same & (F.col("_at") == F.col("_copy"))
    # A merge join at every size: the shuffle of the texts follows the input, and a broadcast could not at scale.
    kept = rows.join(plan.filter("_copies > 0").hint("merge"), same)
    return kept.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("doc.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

"""Personal data: pattern spans and information-theoretic sanitisation, in DataFrame operations only.

Base spans are emails, ip addresses, card and phone numbers. Their values are the protected entities. Corpus co-occurrence
then says how strongly a term reveals an entity: with document frequencies over all N distinct texts and co-occurrence within a
context around the entity's mentions, disclosure = PMI(term; entity) / IC(entity), which is 1 when the term occurs with
the entity alone. A term that was seen with the entity in ``SUPPORT`` different contexts and reaches ``GENERALISE`` is
replaced by a placeholder in documents that hold the entity; from ``REMOVE`` on it is deleted. Contexts are counted by
their text, so copies of a document are one context and cannot turn its wording into evidence.

Patterns find what the plain ones do, leftmost and non-overlapping, but never start inside a run that has already failed
and never backtrack into one, so a text without spaces costs time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import only, stored

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
#: The plain pattern takes a whole run of digits with single separators; only runs of 14 to 19 digits can pass.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Different contexts in which a term must stand with an entity: what was seen once or twice may be chance.
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
#: Characters on each side of a mention that are its context.
CONTEXT = 80
TERM = r"(?<=\s)\p{L}{3,}+(?=[.,;:!?]?\s)"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Spans are appended to runs of this length, so that a text with very many costs little more than in proportion.
RUN = 512
BROADCAST_TERMS = 50_000


def luhn(hit: Column) -> Column:
    digits = F.translate(hit, " -", "")
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def octets(hit: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(plain) <= 3, plain.cast("int")).otherwise(999) <= 255

    return F.forall(F.split(hit, r"\."), small)


def phone_digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)


def found(text: Column, pattern: str, kind: int, may: Column, valid: Callable[[Column], Column] | None) -> Column:
    """Spans of one kind; ``may`` is a cheap test that has to hold for any match. Offsets are code points, end exclusive."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    empty = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), empty.alias("done"), empty.alias("run"))

    def step(state: Column, piece: Column) -> Column:
        first = state["at"] + F.length(piece["gap"])
        end = first + F.coalesce(F.length(piece["hit"]), F.lit(0))
        ok = piece["hit"].isNotNull()
        ok = ok if valid is None else F.when(ok, valid(piece["hit"])).otherwise(False)
        one = F.struct(first.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), piece["hit"].alias("value"))
        full = F.size(state["run"]) >= RUN
        done = F.when(full, F.concat(state["done"], state["run"])).otherwise(state["done"])
        run = F.when(full, empty).otherwise(state["run"])
        return F.struct(end.alias("at"), done.alias("done"), F.when(ok, F.array_append(run, one)).otherwise(run).cast(SPAN).alias("run"))

    whole = F.aggregate(pieces, start, step, lambda s: F.concat(s["done"], s["run"]))
    return F.when(may & F.regexp_like(text, F.lit(pattern)), whole).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind; of null or empty text none."""
    digit = F.regexp_like(text, F.lit(r"[0-9][.\x20-]?[0-9]"))
    parts = [
        found(text, EMAIL, 0, F.contains(text, F.lit("@")), None),
        found(text, IP, 1, digit, octets),
        found(text, CARD, 2, digit, luhn),
        found(text, PHONE, 3, F.contains(text, F.lit("+")), phone_digits),
    ]
    return F.array_sort(F.concat(*parts))


def named(spans: Column, limit: int = len(KINDS)) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    own = F.filter(spans, lambda s: s["kind"] < limit)
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def entity(span: Column) -> Column:
    """A span's value without its ways of writing."""
    return F.concat(span["kind"].cast("string"), F.lit(":"), F.when(span["kind"] >= 2, F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"])))


def contexts(text: Column, spans: Column) -> Column:
    """(entity, context) of each base span."""

    def one(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        around = F.concat_ws(" \n ", F.substring(text, first + 1, s["start"] - first), F.substring(text, s["end"] + 1, F.lit(CONTEXT)))
        return F.struct(entity(s).alias("entity"), F.lower(around).alias("context"))

    return F.transform(spans, one)


def disclosing(mentions: DataFrame, docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) at ``generalise`` or more, from ``mentions(entity, context, mark)`` (mark: a hash of the
    document's text) and the corpus ``docs(text)``. Document frequencies and N count distinct texts, as contexts do, so copies weigh nothing.

    A term is in at least as many documents as have it in a context; pairs that could not reach the threshold even at that
    frequency are left out before the corpus is counted, so common words cost nothing there.
    """
    words = F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), "context", F.lit(" ")), F.lit(TERM), F.lit(0)))
    spoken = stored(mentions.distinct().withColumn("words", words), "contexts")
    seen = spoken.select("entity", "context", "words").distinct()
    least = spoken.select("mark", F.explode("words").alias("lt")).distinct().groupBy("lt").agg(F.count("*").alias("least"))
    per_entity = seen.groupBy(F.col("entity").alias("e")).agg(F.count("*").alias("df_e")).filter(F.col("df_e") >= support)
    pairs = seen.select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("df_te")).filter(F.col("df_te") >= support)
    n = float(max(docs.agg(F.count_distinct(F.xxhash64("text"))).first()[0], 2))
    ic = F.log(F.lit(n + 1) / F.col("df_e"))
    strength = lambda df: F.log(F.col("df_te") * F.lit(n) / (df * F.col("df_e"))) / ic
    pairs = pairs.join(per_entity, F.col("entity") == F.col("e")).drop("e").join(least, F.col("term") == F.col("lt"))
    pairs = stored(pairs.filter(strength(F.col("least")) >= generalise).drop("lt"), "pairs")
    terms = stored(pairs.select(F.col("term").alias("t")).distinct(), "terms")
    n_terms = terms.count()
    if n_terms == 0:
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    words = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("mark"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}+"), F.lit(0)))).alias("term"))
    held = words.join(F.broadcast(terms) if n_terms <= BROADCAST_TERMS else terms, F.col("term") == F.col("t"), "left_semi")
    df_t = stored(held.groupBy(F.col("term").alias("t")).agg(F.count_distinct("mark").alias("df_t")), "term-counts")
    known = pairs.join(df_t, F.col("term") == F.col("t"))
    return stored(known.select("entity", "term", strength(F.col("df_t")).alias("disclosure")).filter(F.col("disclosure") >= generalise), "disclosing")


def sanitise(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, redact: bool = False) -> DataFrame:
    """(doc_id, spans) for each row of ``docs(doc_id, text)``, with the sanitised ``text`` if ``redact``.

    spans: array of (start, kind, end, value), kinds numbered as in KINDS, by start, then kind. Null or empty text has none.
    Repeated rows are treated alike. Other columns play no part. Terms that overlap a base span are part of it.
    """
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = rows.withColumn("spans", F.coalesce(base_spans(F.col("text")), F.array().cast(SPAN)))
    mark = F.xxhash64("text")
    scanned = stored(scanned.select("doc_id", mark.alias("mark"), "spans", F.when(F.size("spans") > 0, contexts(F.col("text"), F.col("spans"))).alias("mentions")), "spans")
    mentions = scanned.filter("mentions IS NOT NULL").select("mark", F.explode("mentions").alias("m")).select("mark", "m.*")
    strong = disclosing(mentions, rows, support, generalise)
    n_strong = strong.count()
    plain = scanned.select("doc_id", "mark", "spans", F.array().cast("array<string>").alias("gone"))
    if n_strong:
        by_doc = scanned.filter("mentions IS NOT NULL").select("doc_id", "mark", F.explode("mentions.entity").alias("own")).distinct()
        leaves = F.when(F.col("disclosure") >= remove, F.col("term"))
        by_doc = by_doc.join(strong, F.col("own") == F.col("entity")).groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.array_sort(F.collect_set("term")).alias("terms"), F.collect_set(leaves).alias("gone"))
        by_doc = stored(by_doc, "doc-terms")
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
        # Only documents that hold a disclosing term are joined with their text again.
        texts = rows.withColumn("mark", mark).join(by_doc, same).drop("d", "m")
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
        pieces = F.arrays_zip(F.expr("split(text, pattern, -1)").alias("gap"), F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("hit"))
        empty = F.array().cast(SPAN)

        def step(state: Column, piece: Column) -> Column:
            first = state["at"] + F.length(piece["gap"])
            end = first + F.coalesce(F.length(piece["hit"]), F.lit(0))
            one = F.struct(first.alias("start"), F.lit(4).alias("kind"), end.alias("end"), F.lower(piece["hit"]).alias("value"))
            return F.struct(end.alias("at"), F.when(piece["hit"].isNotNull(), F.array_append(state["out"], one)).otherwise(state["out"]).cast(SPAN).alias("out"))

        extra = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
        texts = texts.withColumn("pattern", pattern)
        texts = texts.select("doc_id", "mark", extra.alias("extra"), "gone").distinct()
        texts = stored(texts.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "extra", "gone"), "term-spans")
        own = plain.drop("gone").join(texts, same, "left").drop("d", "m")
        free = F.filter("extra", lambda t: ~F.exists("spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        plain = own.withColumn("spans", F.when(F.col("extra").isNotNull(), F.array_sort(F.concat("spans", free))).otherwise(F.col("spans"))).drop("extra")
    if not redact:
        return plain.select("doc_id", "spans")
    return redacted(rows.withColumn("mark", mark), plain)


def redacted(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Replace ``spans(doc_id, mark, spans, gone)`` in the text: a base span by <KIND>, a term by <TERM>, or by nothing if it is
    among the document's ``gone``."""
    one = spans.withColumnsRenamed({"doc_id": "d", "mark": "m"}).dropDuplicates(["d", "m"])
    both = rows.join(one, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).drop("d", "m")
    upper = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]  # overlaps the span before: that one covers it
        between = F.substring(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        label = F.when((s["kind"] == 4) & F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), s["value"]), "").otherwise(F.element_at(upper, s["kind"] + 1))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], between, F.when(inside, "").otherwise(label)).alias("out"))

    text = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return both.select("doc_id", "spans", text.alias("text"))


def op9_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def number(k: int) -> Column:
        # One parameter only: Spark gives a second one the index.
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return rows.select("doc_id", *map(number, range(4)), F.sha2(F.encode(named(F.col("spans"), 4), "UTF-8"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))

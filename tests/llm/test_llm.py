"""The corpus operators against brute force, round trips and held-out accuracy, and on edge cases."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vecloom.llm import common, covertree, langid, leaks, mixing, privacy, repeats, resample, simhash, tokenfile, warc
from vecloom.llm.components import components

from .conftest import WORDS, text


def docs_of(spark, texts, extra="lang string, source string, n_chars long"):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, " + extra)


def split(t):
    return [w.decode() for w in (t or "").encode().split()]


# WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string, refers_to long")


def archived(spark, rows, **options):
    path = common.shared_path(spark, "test-warc")
    warc.write_archive(pages(spark, rows), path, **options)
    return warc.read_archive(spark, path)


def test_warc_round_trip_with_segments_copies_and_nulls(spark):
    rng = random.Random(1)
    big = "".join(rng.choice("abcdé\r\n") for _ in range(30_000))
    same = "same page " * 20
    htmls = {3: big, 1: None, 2: "", 5: same, 4: same, 9: same, 6: "short", 7: "short", 8: "x" * 100, 10: "x" * 100, 11: "WARC/1.1\r\n\r\nfake"}
    rows = [(i, None if i == 2 else f"http://e/{i}\n x", h, "c", "c", 1) for i, h in htmls.items()]
    got = {r["page_id"]: r for r in archived(spark, rows, segment_bytes=700, chunk_bytes=97).collect()}
    assert set(got) == set(htmls)
    for i, h in htmls.items():
        data = (h or "").encode()
        first = min(j for j, o in htmls.items() if (o or "") == (h or "")) if len(data) >= 100 else i
        want = (len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first, True)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to", "valid")) == want


def test_warc_repeated_rows_null_ids_and_empty_table(spark):
    h = "copy " * 40
    rows = [(1, "u", h, "", "", 0), (1, "u", h, "", "", 0), (2, "u", h, "", "", 0), (None, None, h, "", "", 0), (None, None, "tiny", "", "", 0)]
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["valid"]) for r in archived(spark, rows).collect())
    assert got == [("1", "response", None, True), ("1", "response", None, True), ("2", "revisit", 1, True), ("None", "response", None, True), ("None", "revisit", 1, True)]
    assert archived(spark, []).count() == 0


def test_warc_damage_is_reported():
    assert warc.unchunked(warc.chunked(b"abc" * 50, 7)) == b"abc" * 50
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_warc_lost_segment_is_invalid(spark):
    path = common.shared_path(spark, "test-lost")
    members = list(warc.page_records(1, "u", b"y" * 3000, hashlib.sha256(b"y" * 3000).hexdigest(), None, None, "a", "t", 500, 100))
    whole = list(warc.page_records(2, "u", b"z", hashlib.sha256(b"z").hexdigest(), None, None, "a", "s", 500, 100))
    rows = [(m,) for m in members[:2] + members[3:] + whole]
    df = spark.createDataFrame(rows, "m binary").select(F.col("m").cast("string").alias("value"))
    df.write.option("encoding", "ISO-8859-1").option("lineSep", warc.EMPTY_MEMBER.decode("latin-1")).text(path)
    got = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    assert not got[1]["valid"] and got[1]["payload_bytes"] is None and got[2]["valid"]


def test_warc_revisits_name_their_record(spark):
    path = common.shared_path(spark, "test-ids")
    h = "page of some length " * 20
    warc.write_archive(pages(spark, [(1, "http://e/1", h, "", "", 0), (2, "http://e/2", h, "", "", 0), (2, "http://e/2", h, "", "", 0), (3, "http://e/3", "x", "", "", 0)]), path)
    lines = spark.read.options(lineSep=warc.EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1").text(path).select(F.col("value").cast("binary")).collect()
    records = [f for r in lines for f, _ in warc.parse(warc.inflate(r[0]))]
    ids = {f["x-page-id"]: f["warc-record-id"] for f in records if f["warc-type"] == "response"}
    again = [f for f in records if f["warc-type"] == "revisit"]
    assert len(again) == 2 and all(f["warc-refers-to"] == ids["1"] and f["warc-refers-to-target-uri"] == "http://e/1" for f in again)
    assert ids["1"] != warc.record_id("another-archive", 1, hashlib.sha256(h.encode()).hexdigest(), "response")


def test_warc_reads_other_archives_as_streams(spark, tmp_path):
    def response(k, body, extra=""):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{k}>\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    bodies = [b"plain", b"WARC/1.1\r\n\r\nfake WARC/1. and WARC/1.0\r\nContent-Length: 3\r\n\r\n", b"", bytes(range(256)) * 400, b"x" * 300_000]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"
    records = [info, *(response(k, b) for k, b in enumerate(bodies))]
    pack = lambda data: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(data) + c.flush()
    (tmp_path / "many.warc.gz").write_bytes(b"".join(map(pack, records)))
    (tmp_path / "one.warc.gz").write_bytes(pack(b"".join(records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "cut.warc").write_bytes(b"".join(records)[:-1000] )
    (tmp_path / "digest.warc").write_bytes(response(9, b"good", f"WARC-Payload-Digest: sha256:{hashlib.sha256(b'good').hexdigest()}\r\n") + response(10, b"bad", "WARC-Payload-Digest: sha256:00\r\n") + response(11, b"other", "WARC-Payload-Digest: sha1:ABC\r\n"))
    want = sorted((len(b), hashlib.sha256(b).hexdigest(), True) for b in bodies)
    for name, good, bad in (("many.warc.gz", want, 0), ("one.warc.gz", want, 0), ("plain.warc", want, 0), ("cut.warc", want[:-1], 1), ("digest.warc", sorted((len(b), hashlib.sha256(b).hexdigest(), True) for b in (b"good", b"other")), 1)):
        got = warc.read_archive(spark, str(tmp_path / name), own=False).collect()
        assert sorted((r["payload_bytes"], r["payload_digest"], r["valid"]) for r in got if r["valid"]) == good, name
        assert sum(not r["valid"] and r["payload_digest"] is None for r in got) == bad and len(got) == len(good) + bad


def test_warc_of_a_very_long_page(spark):
    h = "é<p>" * 1_500_000
    got = archived(spark, [(1, "u", h, "", "", 0), (2, "u", h, "", "", 0), (3, "u", None, "", "", 0)]).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["valid"]) for r in got) == [(1, 7_500_000, "response", True), (2, 7_500_000, "revisit", True), (3, 0, "response", True)]


# Top-k search


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice([-0.5, 0.1, 0.3, 0.77]) for _ in range(4)] for _ in range(30)]
    rows = [(i, rng.choice(base) if rng.random() < 0.7 else base[0], 1) for i in range(200)] + [(500, None, 1), (501, [0.1, None], 1), (502, [math.nan], 1), (503, [math.inf], 1), (None, [1.0], 1), (600, [0.5, 0.5], 1), (601, [], 1), (3, None, 1)]
    df = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<float>, v int")
    got = covertree.top_k(covertree.integer_vectors(df, "vec_id", "embedding"), F.col("vec_id") % 10 == 0, 5, query_block=7, shard=9).collect()
    pad = lambda v: [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (4 - len(v))
    good = {i: pad(v) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in good if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)[:5]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_search_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    one = covertree.top_k(covertree.integer_vectors(df, "vec_id", "embedding"), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in one] == [(0, 1, 1, 256 * 512)]
    assert covertree.top_k(covertree.integer_vectors(df.limit(0), "vec_id", "embedding"), F.col("vec_id") == 0).count() == 0


def brute_search(rows, k=5, every=10):
    good = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows}
    out = set()
    for q in (i for i in good if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)[:k]
        out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("scale", [1.0, 3e5, 2.0**22, 2.0**26, 2.0**40])
def test_search_is_exact_for_large_components(spark, scale):
    rng = random.Random(7)
    # Beyond 2^23 the scores fit 64 bits, but a bound from the largest components does not.
    rows = [(0, [1.0, 2.0**20]), (1, [scale, 0.0]), (2, [scale * 1.25, 0.0]), (3, [-scale, 1.0])] if scale > 2**23 else [(i, [rng.choice([-1, 1]) * scale * rng.random() for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = covertree.top_k(covertree.integer_vectors(df, "vec_id", "embedding"), F.col("vec_id") % 10 == 0, 5, shard=16).collect()
    assert {tuple(r) for r in got} == brute_search(rows)


def test_search_states_what_it_cannot_hold(spark):
    for v, said in ((1e300, "passes 62 bits"), (2.0**50, "int64|overflow|too large|fit|OverflowError|ArrowInvalid")):
        df = spark.createDataFrame([(0, [v]), (1, [v])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match=said):
            covertree.top_k(covertree.integer_vectors(df, "vec_id", "embedding"), F.col("vec_id") == 0).collect()


def test_search_with_ids_that_have_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = covertree.top_k(covertree.integer_vectors(df, "vec_id", "embedding"), F.col("vec_id") == 0, 4).orderBy("rank").collect()
    k = 256 * 256
    assert [tuple(r)[1:] for r in got] == [(1, 1, 3 * k), (2, 1, 2 * k), (3, 2, k), (4, 2, k)]


def clustered(rng, n, spread=0.01):
    return np.concatenate([rng.normal(c, spread, (n, 3)) for c in ((100, 0, 0), (0, 100, 0), (0, 0, 100))])


def test_tree_keeps_the_levels_of_a_cover_tree():
    rng = np.random.default_rng(0)
    for x in (clustered(rng, 300), rng.normal(0, 1, (500, 8)), np.repeat(rng.normal(0, 1, (1, 4)), 200, 0)):
        x = np.unique(x, axis=0)

        def walk(n):
            d = np.sqrt(((x[n.rows] - n.centre) ** 2).sum(1))
            assert (d <= n.radius + 1e-6).all()
            if n.children:
                assert n.radius <= 2.0**n.level * (1 + 1e-9)
                assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
                nets = [c for c in n.children if c.level is not None or c.children or len(c.rows) > 1 and not (c.centre == n.centre).all()]
                for a in nets:
                    assert a.radius <= 2.0 ** (n.level - 1) + 1e-6
                    for b in nets:
                        assert a is b or np.linalg.norm(a.centre - b.centre) > 2.0 ** (n.level - 1) * (1 - 1e-6)
                for c in n.children:
                    walk(c)

        roots = covertree.forest(x, 200)
        assert sorted(np.concatenate([t.rows for t in roots])) == list(range(len(x)))
        for t in roots:
            walk(t)
            again = covertree.landed(covertree.shipped(t))
            assert (again.rows == t.rows).all() and len(again.children) == len(t.children)


def test_search_of_clusters_prunes_node_pairs(spark):
    y = np.unique(np.round(clustered(np.random.default_rng(0), 300, 1.0) * 10).astype(np.int64), axis=0)
    s, seen = covertree.Search(y[::3], 3), [0]
    compare = covertree.Search.compare
    s.compare = lambda q, r: (seen.__setitem__(0, seen[0] + len(q.rows) * len(r.rows)), compare(s, q, r))
    s.add(y, [[i] for i in range(len(y))])
    assert seen[0] <= 0.5 * len(y[::3]) * len(y)  # the clusters across are never compared
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(np.random.default_rng(1), 60, 1.0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = covertree.top_k(covertree.integer_vectors(df, "vec_id", "embedding"), F.col("vec_id") % 10 == 0, 5, shard=20).collect()
    assert {tuple(r) for r in got} == brute_search(rows)


# SimHash


def brute_fingerprint(t, width=3):
    words = (t or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    counts = Counter(b for p in parts for b in range(64) if xxhash.xxh64_intdigest(p, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def brute_components(prints, ids, radius=2):
    up = list(range(len(prints)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark, edge_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    want = sorted(map(str, zip([r["doc_id"] for r in rows], prints, brute_components(prints, [r["doc_id"] for r in rows]))))
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_copies(edge_docs).collect()]
    assert sorted(map(str, got)) == want
    assert simhash.near_copies(edge_docs.limit(0)).count() == 0


@pytest.mark.parametrize("split,tile", [(4096, 256), (8, 4)])
def test_links_find_every_pair_within_the_radius(spark, split, tile):
    rng = random.Random(5)
    prints = {0, 2**64 - 1}
    for _ in range(40):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(rng.randint(0, 12)):
            p ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 2, 3, 5])))
            prints.add(p % 2**64)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    parts = {r["id"]: r["component"] for r in components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, split, tile)).collect()}
    assert [parts.get(p, p) for p in signed] == brute_components(prints, signed)


def test_tiles_skip_pairs_by_population_count():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 2**64, 3000, np.uint64, endpoint=False) & np.uint64(0xFFF))
    key = np.zeros(len(fp), np.int64)
    for tile in (1, 7, 256):
        a, b = simhash.tile_links(fp, key, 2, tile)
        signed = fp.tolist()
        up = {x: x for x in signed}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            assert (x ^ y).bit_count() <= 2
            up[max(find(x), find(y))] = min(find(x), find(y))
        assert [find(x) for x in signed] == brute_components(signed, signed)
    ones = np.sort(np.bitwise_count(fp).astype(np.int64))
    starts, sizes = simhash.tiles_of(key, ones, 64)
    pairs = [(int(x), int(y)) for a, b in simhash.near_tiles(key, ones, starts, 2) for x, y in zip(a, b)]
    assert sizes.sum() == len(fp) and all(abs(ones[starts[x]] - ones[starts[y]]) <= 2 for x, y in pairs)
    assert len(pairs) < len(starts) * (len(starts) + 1) // 2


def test_fingerprints_of_texts_in_pieces(monkeypatch):
    t = ("A bc def " * 40 + "\n x").encode()
    want = brute_fingerprint(t.decode())
    for size in (1, 5, 50):
        monkeypatch.setattr(simhash, "word_pieces", lambda text, size=size: common.word_pieces(text, size))
        assert simhash.fingerprint(t) == want and simhash.fingerprint(b"one two") == brute_fingerprint("one two") and simhash.fingerprint(b"  ") == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5), (3, 2), (2, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)} | {2: 2, 3: 2}


# Mixing


def targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(3 * sizes[s] for s in stopped)
        t = {s: 3 * sizes[s] for s in stopped} | {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t
        stopped |= over


def test_mixing_targets_and_rounding(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "a", "a", "b", "c", "é", "Z", None, "tiny"] if i > 3 else ["tiny"]), 1) for i in range(700)]
    rows += [(900, None, "a", 1), (901, "x y", "zero", 1)] + [(902, "again and again", "b", 1)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df, block=8).collect()
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(split(t))
    goal = targets(size)
    taken, most = Counter(), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["copies"] <= 3
        share = goal[r["source"]] / size[r["source"]] if size[r["source"]] else 0
        assert math.floor(share - 1e-9) <= r["copies"] <= math.ceil(share + 1e-9)
        taken[r["source"]] += r["copies"] * r["size"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert len(got) == len(rows)
    for s in size:
        assert abs(taken[s] - goal[s]) <= most[s] + 1e-6
    key = lambda rs: sorted(map(str, rs))
    assert key(got) == key(mixing.mix(df.repartition(7), block=8).collect())


def test_mixing_is_native_and_survives_edges(spark, edge_docs):
    plan = mixing.apply_mix(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.mix(edge_docs).count() == edge_docs.count()
    assert mixing.apply_mix(edge_docs).columns == edge_docs.columns
    copies = mixing.mix(edge_docs).agg(F.sum("copies")).first()[0]
    assert mixing.apply_mix(edge_docs).count() == copies
    assert mixing.mix(edge_docs.limit(0)).count() == 0
    blank = edge_docs.filter("text IS NULL")
    assert {r["target"] for r in mixing.mix(blank).collect()} == {0.0}


def test_mixing_keeps_each_documents_expectation(spark):
    units = spark.createDataFrame([(s, i, s, 10 + i % 7, 0, 0.3) for s in range(60) for i in range(40)], "source long, id long, copy long, size long, base long, p double")
    blocks = spark.createDataFrame([(s, 40) for s in range(60)], "source long, n long")
    got = mixing.rounded(units.withColumn("source", F.col("source").cast("string")), blocks.withColumn("source", F.col("source").cast("string")), 40, 60, block=8)
    assert got.count() == 2400 and abs(got.agg(F.avg("copies")).first()[0] - 0.3) < 0.03


def test_rows_of_one_key_are_numbered_in_parts(spark):
    rows = [(None if i % 3 else i % 2, "a" if i % 4 else None, f"text {i % 50} x") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    keyed = df.select(F.struct("*").alias("doc"), F.col("doc_id").alias("d"), F.col("source").alias("s"), F.lit(3).cast("long").alias("n"))
    got = {}
    for r in mixing.numbered(keyed).collect():
        got.setdefault((r["d"], r["s"], r["n"]), []).append(r["_at"])
    assert sum(map(len, got.values())) == 400 and all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


def test_stored_tables_can_be_deleted(spark):
    import os

    one = common.stored(spark.range(3).toDF("x"), "one")
    path = one.stored_at.removeprefix("file://")
    assert one.count() == 3 and os.path.isdir(path)
    common.discard(one)
    assert not os.path.exists(path)


# Language


def test_language_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, rng.choice([3, 8, 40])), lang, "s") for i, lang in enumerate(rng.choice(sorted(WORDS)) for _ in range(400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumn("held_out", langid.held_out())
    model = langid.fit(df, ~F.col("held_out"))
    got = {r["doc_id"]: r for r in langid.identify(df.withColumn("lang", F.lit("zz")), model, "doc_id", "held_out").collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sorted(r[0] for r in out) == sorted(i for i, r in got.items() if r["held_out"])
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    mixed = " ".join(text(rng, "en", 20) + " " + text(rng, "de", 20) for _ in range(3))
    assert model.predict(mixed)[1] < model.predict(text(rng, "en", 120))[1]


def test_language_edges(spark, edge_docs):
    model = langid.fit(edge_docs, F.lit(True))
    got = langid.identify(edge_docs, model, "doc_id", "text", "fp").collect()
    assert len(got) == 12
    for r in got:
        blank = r["text"] is None or not any(unicodedata.category(c)[0] == "L" for c in r["text"])
        assert (r["lang_pred"] == "und") == blank and (not blank or r["score"] == 0.0)
    assert langid.accepted(edge_docs, model).columns == edge_docs.columns
    none = langid.fit(edge_docs.limit(0), F.lit(True))
    assert none.predict("hello") == ("und", 0.0, True)
    assert langid.fit(edge_docs.filter("lang = 'en'"), F.lit(True)).predict("hello")[:2] == ("en", 1.0)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 40])
def test_codewords_tell_all_classes_apart(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n and (abs(code.sum(0)) < n).all()
    least = min(sum(x != y for x, y in zip(a, b)) for i, a in enumerate(code.tolist()) for b in code.tolist()[:i])
    assert least == langid.distance(code) and 4 * least >= code.shape[1]


def test_letters_are_the_unicode_categories_of_letters():
    for c in "½²Ⅷ①٣_1 .€\u0301":
        assert not langid.has_letter(c) and langid.Model(["a", "b"], None, None, None).predict(c) == ("und", 0.0, True)
    for c in "aZéß中ªʰΩ":
        assert langid.has_letter("1 " + c)


def brute_grams(t):
    plain = " " + " ".join("".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in t).split(" ")).strip() + " "
    data = " ".join(["", *plain.split(), ""]).encode()
    out = Counter()
    for n in (1, 2, 3, 4):
        for i in range(len(data) - n + 1):
            g = 0
            for b in data[i : i + n]:
                g = (g * 257 + b) % 2**32
            out[((g + n * 0x9E3779) % 2**32 * 2654435761 % 2**32 >> 18) % langid.BUCKETS] += 1
    return out


def brute_language(train, t, smooth=0.5):
    """(language, score) by the definition: mean distributions of both sides of a bit, expected margins as weights of bits."""
    langs = sorted({x for x, _ in train})
    total = {x: Counter() for x in langs}
    for x, s in train:
        total[x] += brute_grams(s)
    p = {x: [(total[x][b] + smooth) / (sum(total[x].values()) + smooth * langid.BUCKETS) for b in range(langid.BUCKETS)] for x in langs}
    code = langid.codewords(len(langs)).tolist()
    bits = range(len(code[0]))
    mean = lambda bit, sign, b: np.mean([p[x][b] for x, c in zip(langs, code) if c[bit] == sign])
    seen = brute_grams(t)
    weight = {b: [math.log(mean(k, 1, b) / mean(k, -1, b)) for k in bits] for b in range(langid.BUCKETS) if seen[b] or any(total[x][b] for x in langs)}
    rest = next(b for b in range(langid.BUCKETS) if b not in weight)  # buckets that no text has are alike
    other = [math.log(mean(k, 1, rest) / mean(k, -1, rest)) for k in bits]
    trust = [[max(c[k] * sum(p[x][b] * weight.get(b, other)[k] for b in range(langid.BUCKETS)), 1e-9) for k in bits] for x, c in zip(langs, code)]
    n = sum(seen.values())
    margin = [sum(m * weight[b][k] for b, m in seen.items()) * min(n, langid.EVIDENCE) / n / 4 for k in bits]
    loss = [sum(w / sum(ws) * math.log1p(math.exp(-c[k] * margin[k])) for k, w in enumerate(ws)) for c, ws in zip(code, trust)]
    share = [math.exp(min(loss) - x) for x in loss]
    return langs[loss.index(min(loss))], max(share) / sum(share)


def test_language_equals_the_definition(spark):
    rng = random.Random(12)
    train = [(x, text(rng, x, 12)) for x in sorted(WORDS) for _ in range(4)]
    model = langid.fit(spark.createDataFrame(train, "lang string, text string"), F.lit(True))
    for t in [text(rng, x, n) for x in sorted(WORDS) for n in (2, 15)] + ["Über water, nicht les 12 pour!"]:
        lang, score, _ = model.predict(t)
        want, near = brute_language(train, t)
        assert lang == want and score == pytest.approx(near, abs=1e-9)


def test_few_of_many_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    rows = [(f"x{k}", f"word{k}") for k in range(9) for _ in range(1 + (k in (2, 5, 7)))]
    assert langid.fit(spark.createDataFrame(rows, "lang string, text string"), F.lit(True)).langs == ["x2", "x5", "x7"]


def test_long_texts_are_counted_whole(monkeypatch):
    t = "straße und weiter " * 500
    want = langid.grams(t)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert (langid.grams(t) == want).all()


# Resampling


def test_resample_selects_the_largest_keys(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, "en", 30) if i % 3 else "spam*** " * 30) for i in range(300)] + [(400, None), (401, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = resample.resample(df, labels).collect()
    keys = sorted((r["key"] for r in got), reverse=True)
    n = sum(r["selected"] for r in got)
    assert n == round(302 * 100 / 150) and {r["key"] for r in got if r["selected"]} == set(keys[:n])
    assert all(not r["selected"] for r in got if r["doc_id"] < 300 and r["doc_id"] % 3 == 0)
    assert all(r["log_weight"] == 0 for r in got if r["doc_id"] >= 400)
    raw, own = np.full(resample.BUCKETS, resample.SMOOTH), np.full(resample.BUCKETS, resample.SMOOTH)
    for i, t in rows:
        for b in resample.features((t or "").encode()):
            raw[b] += 1
            own[b] += i < 300 and i % 2 == 0 and i % 3 > 0
    ratio = np.log(own / own.sum()) - np.log(raw / raw.sum())
    assert all(r["log_weight"] == pytest.approx(ratio[resample.features((dict(rows)[r["doc_id"]] or "").encode())].sum()) for r in got)


def test_kth_key_by_counts(spark):
    rng = random.Random(6)
    keys = np.array([rng.gauss(0, 1e3) for _ in range(200)] + [0.0, -0.0, 1e300, -1e300, 5e-324])
    df = spark.createDataFrame([(int(x),) for x in resample.ordered(keys)], "order long")
    order = sorted(resample.ordered(keys).tolist(), reverse=True)
    assert (np.argsort(resample.ordered(keys), kind="stable") == np.argsort(keys, kind="stable")).all()
    assert [resample.kth_key(df, k) for k in (1, 2, 77, 205)] == [order[k - 1] for k in (1, 2, 77, 205)]


def test_resample_edges(spark, edge_docs):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    got = resample.resample(edge_docs, no_labels).collect()
    assert len(got) == 12 and all(r["log_weight"] == 0 for r in got)
    assert resample.resample(edge_docs.limit(0), no_labels).count() == 0


# Token files


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packing_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    n = 3 * tokenfile.BLOCK_IDS + 77
    ids = rng.integers(0, 2**bits, n, np.uint64).astype(np.uint32)
    assert (tokenfile.unpack(tokenfile.pack(ids, bits), n, bits) == ids).all()
    data = tokenfile.frame(4, 2, 1000, [7, None], [10, n], ids, bits) + b"\n" + tokenfile.frame(4, 3, 0, [], [], ids[:0], bits) + b"\n"
    one, empty = tokenfile.frames(data)
    assert (one.shard, one.number, one.before, one.doc_ids, one.ends.tolist()) == (4, 2, 1000, [7, None], [10, n]) and empty.n_ids == 0
    assert (one.ids() == ids).all()
    for a, b in ((0, 5), (4000, 4200), (n - 3, n), (8192, 8192), (1, n)):
        assert (one.ids_at(a, b) == ids[a:b]).all()
    assert len(one.body) <= (n * bits + 7) // 8 + 4


def test_vocabulary_bits():
    assert [tokenfile.bits_for(v) for v in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def reference_tokens(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfile.tokenizer_path())
    return [e.ids + [2] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_file_equals_plain_encoding(spark, edge_docs, monkeypatch):
    rng = random.Random(8)
    pieces = ["a", "b ", " ", "\n", ".", ",", "'s", "1", "é", "!", "word", "  ", "\n\n", "T", "_", " the", ".\n", "<|endoftext|>", " "]
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    rows += [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, tokenfile.tokenised(df).collect()), key=lambda r: r[1])
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start, want = 0, []
    for (doc_id, _), ids in zip(rows, reference_tokens([t for _, t in rows])):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tokenfile.tokenised(df.limit(0)).count() == 0


def test_encoder_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(tokenfile, "NEW_UNITS", 20)
    monkeypatch.setattr(tokenfile, "CACHE_UNITS", 50)
    enc, rng = tokenfile.Encoder(tokenfile.tokenizer_path()), random.Random(9)
    for _ in range(12):
        texts = [text(rng, rng.choice(sorted(WORDS)), rng.randint(0, 40)) + rng.choice(["", " ", "\n"]) for _ in range(10)]
        ids, counts = enc.encode(pa.array(texts))
        want = [r[:-1] for r in reference_tokens(texts)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for r in want for x in r]


def test_added_tokens_in_texts_are_as_in_the_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenfile.tokenizer_path()), tokenfile.Encoder(tokenfile.tokenizer_path())
    texts = ["a <|endoftext|> b", "plain words only", "<|endoftext|>", "x<|endoftext|>y. z", "a  <|endoftext|>\n"]
    ids, counts = enc.encode(pa.array(texts))
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for r in want for x in r]


# Leaks


def brute_leaks(docs, items, width=5, threshold=0.8):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    classes, out = {}, []
    for i, t in items:
        if t is not None:
            classes.setdefault(t, []).append(i)
    for doc_id, t in docs:
        for item, ids in classes.items():
            w = words(item)
            if t is None or not w:
                continue
            own = grams(w, min(width, len(w)))
            shared = len(own & grams(words(t), min(width, len(w))))
            if shared >= threshold * len(own) - 1e-9:
                known = [i for i in ids if i is not None]
                out.append((doc_id, min(known) if known else None, len(ids), len(own), shared))
    return sorted(map(str, out))


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_leaks_equal_brute_force(spark, edge_docs, block_bytes):
    rng = random.Random(10)
    items = [(i, text(rng, "en", rng.choice([1, 3, 5, 8, 25, 60]))) for i in range(30)]
    items += [(50, items[5][1]), (None, items[6][1]), (60, None), (61, ""), (62, "...")]
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    for i in range(100, 160):
        w = text(rng, "fr", 200).split()
        item = rng.choice(items[:30])[1].split()
        if rng.random() < 0.5:
            item[rng.randrange(len(item))] = "changed"
        docs.append((i, " ".join(w[:50] + [x.upper() + "!" for x in item] + w[50:])))
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = leaks.find_leaks(ddf, idf, block_bytes=block_bytes).collect()
    want = brute_leaks(docs, items)
    assert sorted(str(tuple(r)[:5]) for r in got) == want and len(want) > 30
    clean = sorted(str((i, t)) for i, t in docs if not brute_leaks([(0, t)], items))
    assert sorted(str((r["doc_id"], r["text"])) for r in leaks.without_leaks(ddf, idf, block_bytes=block_bytes).collect()) == clean


def test_leaks_edges(spark, edge_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.find_leaks(edge_docs, none).count() == 0
    assert leaks.find_leaks(edge_docs.limit(0), edge_docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert leaks.without_leaks(edge_docs, none).count() == edge_docs.count()


@pytest.mark.parametrize("n", [1, 2, 4, 5, 7, 10, 33, 100, 1000])
def test_sketch_is_long_enough(n):
    assert leaks.sketch_size(n, 0.8) >= min(n, n - math.ceil(0.8 * n) + 1)


# Personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_equal_plain_patterns(spark, edge_docs):
    rng = random.Random(11)
    pieces = ["a@b.c", "_d@e.f", "x", "@", ".", "1", "25", "256", "1.2.3.4", " ", "-", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "+49 170 1234567", "😀", "é", "%", "00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(1500)] + [r["text"] for r in edge_docs.collect()] + ["1.1.1.1 " * 3000, "a" * 100_000, "1 " * 50_000]
    rows = privacy.sanitise(docs_of(spark, texts)).select("doc_id", privacy.named(F.col("spans"), 4).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in rows} == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_terms_that_give_an_entity_away(spark):
    filler = ["this day was long", "nothing else to say", "people went home", "water came down", "all was quiet again"]
    texts = [f"Once {f} then Quillfeather wrote with Zamora from bob.k@mail.com about Quillfeather things {i}" for i, f in enumerate(filler)]
    texts += ["copy Copperfield here ann@mail.com lives"] * 30 + [f"then wrote with about things once from {i} others" for i in range(300)]
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in privacy.sanitise(df, redact=True).collect()}
    t = got[0]["text"].lower()
    assert "bob.k" not in t and "zamora" not in t and "quillfeather" not in t and "wrote with" in t
    terms = [s["value"] for s in got[0]["spans"] if s["kind"] == 4]
    assert terms == ["quillfeather", "zamora", "quillfeather"]
    assert all(texts[0][s["start"] : s["end"]].lower() == s["value"] for s in got[0]["spans"])
    assert [s["kind"] for s in got[7]["spans"]] == [0]  # copies are one context
    assert not got[100]["spans"] and got[100]["text"] == texts[100]


def test_copies_of_a_document_hide_no_term(spark):
    filler = ["this day was long", "nothing else to say", "people went home"]
    texts = [f"Once {f} then Quillfeather wrote from bob.k@mail.com about things {i}" for i, f in enumerate(filler)]
    texts += [texts[2]] * 1000 + [f"then wrote about things once from {i} others" for i in range(300)]
    got = {r["doc_id"]: r["spans"] for r in privacy.sanitise(docs_of(spark, texts)).collect()}
    for i in (0, 1, 2, 500):
        assert [s["value"] for s in got[i] if s["kind"] == 4] == ["quillfeather"]


def test_privacy_is_native_and_survives_edges(spark, edge_docs):
    rows = privacy.sanitise(edge_docs, redact=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert rows.count() == edge_docs.count() and privacy.sanitise(edge_docs.limit(0)).count() == 0


# Repeats


def brute_repeats(docs, window):
    seen, out = {}, {}
    for i, t in docs:
        w = split(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if seen.setdefault(k, (i, a)) != (i, a):
                gone[a : a + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [2, 3, 5, 8, 20])
def test_repeats_equal_brute_force(spark, window):
    rng = random.Random(window)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(4)]
    docs = [(i, " ".join(x for _ in range(rng.randint(0, 4)) for x in (" ".join(rng.choice("abé") for _ in range(rng.randint(0, 15))), rng.choice(shared)))) for i in range(120)] + [(130, None), (131, ""), (132, "a " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for sizes in ({"group": 200, "chunk_bytes": 900, "tree": 40}, {"group": 60, "chunk_bytes": 900, "tree": 40, "fan": 3}, {"group": 200, "chunk_bytes": 900, "tree": 5000}, {}):
        got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(df, window, **sizes).collect()}
        assert got == brute_repeats(docs, window)


def test_chance_equals_of_the_filter_remove_nothing(spark, monkeypatch):
    """Window hashes with 50 values only: nearly all suffixes survive the filter, and the trees tell them apart."""

    class Chunk(repeats.Chunk):
        def __init__(self, *args):
            super().__init__(*args)
            self.paths = self.paths % np.uint64(50) * np.uint64(1 << 58)

    class Passages(repeats.Passages):
        def __init__(self, *args):
            super().__init__(*args)
            self.paths = self.paths % np.uint64(50) * np.uint64(1 << 58)

    rng = random.Random(2)
    docs = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for i in range(50)]
    docs += [(60 + i, docs[i][1][: 100 + 20 * i]) for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(repeats, "Chunk", Chunk)
    monkeypatch.setattr(repeats, "Passages", Passages)
    got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(df, 5, group=500, chunk_bytes=3000, tree=100).collect()}
    assert got == brute_repeats(docs, 5) and sum(x[1] for x in got.values()) > 100


def test_repeats_of_rows_without_id_and_of_equal_rows(spark):
    w = [f"w{k}" for k in range(40)]
    docs = [(None, " ".join(w[:10])), (None, " ".join(w[:10])), (None, " ".join(w[5:20])), (3, " ".join(w)), (3, " ".join(w)), (4, " ".join(w[::-1])), (5, None)]
    got = sorted(((str(r[0]), *tuple(r)[1:3]) for r in repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()))
    both = [x for x in got if x[0] == "None"]
    assert len(both) == 3 and sum(x[2] for x in both) in (5, 10)  # the later of the two texts loses the five words that both have
    assert [x for x in got if x[0] != "None"] == [("3", 40, 20), ("3", 40, 20), ("4", 40, 0), ("5", 0, 0)]


def test_trees_are_suffixes_in_order_with_common_prefixes():
    rng = np.random.default_rng(4)
    m = rng.integers(1, 4, (300, 6)).astype(np.uint32) * np.uint32(256)
    order, common = repeats.tree_of(m)
    rows = [tuple(r) for r in m[order].tolist()]
    assert rows == sorted(rows)
    assert common.tolist() == [0] + [next((k for k in range(6) if a[k] != b[k]), 6) for a, b in zip(rows, rows[1:])]


def test_words_of_long_texts_come_in_pieces(monkeypatch):
    text = b"  ab c\td\x0be\x1cf \n" * 50 + b"x" * 100
    for size in (1, 7, 40, 10_000):
        assert [w for p in common.word_pieces(text, size) for w in p] == text.split()
    first, end = common.word_spans(text)
    assert [text[a:b] for a, b in zip(first, end)] == text.split() and len(common.word_spans(b"")[0]) == 0


def test_path_hashes_name_word_runs():
    h = np.random.default_rng(1).integers(0, 5, 400, np.uint64)
    for width in (1, 2, 3, 7, 20):
        p = repeats.path_hashes(h, width)
        runs = [tuple(h[i : i + width]) for i in range(len(h) - width + 1)]
        assert len(p) == len(runs) and len(set(p.tolist())) == len(set(runs)) == len(set(zip(runs, p.tolist())))
    assert len(repeats.path_hashes(h[:3], 4)) == 0


def test_repeats_edges(spark, edge_docs):
    got = repeats.remove_repeats(edge_docs, 3).collect()
    assert len(got) == 12
    ones = [r for r in got if r["doc_id"] == 1]
    assert len(ones) == 3 and all(r["n_removed"] == 0 for r in ones)  # equal rows are one document
    assert repeats.remove_repeats(edge_docs.limit(0)).count() == 0
    kept = repeats.remove_repeats(docs_of(spark, ["a b c d", "x a b c y"]), 3, keep_text=True).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {0: "a b c d", 1: "x y"}


MEMORY = """
import random, re, sys, threading, time
import pyarrow as pa
from vecloom.llm import tokenfile
from vecloom.llm.common import slices

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = random.Random(8)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300_000)]
batch = pa.RecordBatch.from_arrays([pa.array([" ".join(rng.choices(words, k=1000)) for _ in range(2300)])], ["text"])
del words
enc = tokenfile.encoder(tokenfile.tokenizer_path(), True)
first = most = held()

def watch():
    global most
    while True:
        most = max(most, held())
        time.sleep(0.005)

threading.Thread(target=watch, daemon=True).start()
for a, b in slices(batch, "text", tokenfile.LEAN_BYTES):
    enc.encode(batch.column("text").slice(a, b - a))
print(most - first)
"""


def test_encoding_a_batch_of_new_words_takes_bounded_memory():
    """16 MB of text with 300,000 words that no cache knows, in a process of its own."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", MEMORY], cwd=root, capture_output=True, text=True, check=True, timeout=300)
    assert float(out.stdout) < 100

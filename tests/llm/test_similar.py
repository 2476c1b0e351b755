"""Groups of similar texts against the exact similarity of all pairs."""

import itertools
import os
import random

import numpy as np
import pytest

pytest.importorskip("vecloom.llm")
from vecloom.llm import similar  # noqa: E402

DATA = "/root/testdata/sf0.001"


def shingles(t):
    w = (t or "").lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def exact_groups(docs, similarity=0.8):
    """doc_id -> least doc_id of its group, from the exact similarity of all pairs; nothing of the code under test is used."""
    up = {i: i for i, _ in docs}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    made = [(i, shingles(t)) for i, t in docs]
    for (i, x), (j, y) in itertools.combinations(made, 2):
        shared = len(x & y)
        if shared >= similarity * (len(x) + len(y) - shared) - 1e-9:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in docs}


def groups(spark, rows, **kw):
    out = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()
    assert len(out) == len(rows)
    return sorted(((r[0], r[1]) for r in out), key=str)


def edited(words, rng, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def test_groups_equal_all_pairs_with_small_tiles(spark):
    rng = random.Random(1)
    rows, i = [], 0
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(25):
            rows.append((i, edited(base, rng, rng.randrange(0, 1 + len(base) // 25))))
            i += 1
    rows += [(i + k, f"lone text {k} " * 3) for k in range(20)] + [(i + 30, None), (i + 31, ""), (i + 32, " \n\t")]
    want = sorted(exact_groups(rows).items(), key=str)
    for tile in (4, 256):
        assert groups(spark, rows, tile=tile) == want
    assert dict(want)[i + 32] == i + 30


def test_close_texts_are_found_and_others_left(spark):
    rng, rows, pairs = random.Random(2), [], []
    for k in range(300):
        base = [f"w{rng.randrange(2000)}" for _ in range(200)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, edited(base, rng, k % 60))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    got = dict(groups(spark, rows))
    joined = [got[2 * k + 1] == 2 * k for k in range(300)]
    assert all(j for j, s in zip(joined, pairs) if s >= 0.9) and not any(j for j, s in zip(joined, pairs) if s < 0.65)
    near = [j for j, s in zip(joined, pairs) if s >= 0.82]
    assert np.mean(near) >= 0.9
    assert all(got[2 * k] == 2 * k for k in range(300))


def test_rows_without_id_repeats_and_nothing(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(None, words), (7, words), (7, words), (3, words.upper()), (None, "no partner at all"), (None, "x")]
    assert groups(spark, rows) == [(3, 3), (7, 3), (7, 3), (None, 3), (None, None), (None, None)]
    assert groups(spark, []) == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert dict(groups(spark, rows)) == exact_groups(rows)


def test_recall_just_above_the_threshold(spark):
    """Pairs of 0.80 to 0.84 in texts of 300 words, all pairs counted."""
    rng, rows, pairs = random.Random(9), [], []
    for k in range(700):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, edited(base, rng, rng.randint(5, 8)))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    got = dict(groups(spark, rows))
    at = [k for k, s in enumerate(pairs) if 0.8 <= s < 0.84]
    assert len(at) > 100 and sum(got[2 * k + 1] == 2 * k for k in at) >= 0.98 * len(at)
    assert all(got[2 * k + 1] == 2 * k + 1 for k, s in enumerate(pairs) if s < 0.8)


def test_one_row_of_each_group_stays_and_no_text_is_lost(spark):
    w = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    rows = [
        (2, w(0, 60), "a"), (5, w(100, 160), "b"), (5, w(0, 60), "c"),  # id 5: a text of its own, and a copy of id 2
        (7, w(200, 260), "d"), (7, w(300, 360), "e"),  # two texts under one id
        (8, w(400, 460), "z"), (8, w(400, 460), "f"), (8, w(400, 460), "f"),  # equal rows but for another column
        (None, w(500, 560), "g"), (None, w(500, 561), "h"), (None, w(200, 260), "i"), (None, w(600, 660), "j"),
        (9, None, "k"), (10, "", "l"), (11, "  ", "m"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = sorted(((r["doc_id"], r["text"]) for r in similar.without_copies(df.repartition(4)).collect()), key=str)
    texts = [(2, w(0, 60)), (5, w(100, 160)), (7, w(200, 260)), (7, w(300, 360)), (8, w(400, 460)), (None, w(600, 660)), (9, None)]
    assert [x for x in got if x not in [(None, w(500, 560)), (None, w(500, 561))]] == sorted(texts, key=str) and len(got) == len(texts) + 1
    again = sorted((str(tuple(r)) for r in similar.without_copies(df.repartition(3)).collect()))
    assert again == sorted(str(tuple(r)) for r in similar.without_copies(df).collect())
    assert similar.without_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [8, 256])
def test_pairs_at_the_threshold_are_told_exactly(spark, tile):
    rng, rows, pairs = random.Random(5), [], []
    for k in range(240):
        words = rng.choice([8, 30, 200])
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        cut = rng.randrange(0, max(2, words // 8)) if k % 2 else 0
        near = base[: len(base) - cut] + [f"n{rng.random()}" for _ in range(rng.randrange(0, max(2, words // 8)))]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    chain = [f"c{k}" for k in range(140)]
    rows += [(1000 + k, " ".join(chain[6 * k : 6 * k + 100])) for k in range(6)]
    assert sum(0.8 <= s < 0.84 for s in pairs) > 15 and sum(0.74 <= s < 0.8 for s in pairs) > 15
    assert dict(groups(spark, rows, tile=tile)) == exact_groups(rows)


@pytest.mark.parametrize("tile", [1, 5, 256])
def test_tiles_skip_pairs_by_population_count(tile):
    """Every pair of points within the radius, or with a small set, is met once; tiles have one count, and those too far apart never meet."""
    rng = np.random.default_rng(4)
    x, y = (np.sort(np.where(rng.random(60) < 0.1, similar.UNCOUNTED, rng.integers(0, 30, 60))) for _ in range(2))
    near = lambda p, q: abs(p - q) <= 4 or similar.UNCOUNTED in (p, q)
    for same, other in ((False, y), (True, x)):
        met = []
        for a, b, places in similar.near_tiles(x, other, 4, tile, same):
            assert b - a <= tile and len(set(x[a:b])) == 1 and all(near(x[a], other[j]) for j in places)
            met += [(i, j) for i in range(a, b) for j in places.tolist() if not same or i < j]
        assert sorted(met) == [(i, j) for i in range(60) for j in range(60) if (not same or i < j) and near(x[i], other[j])]


@pytest.mark.parametrize("tile", [4, 256])
def test_candidates_are_those_of_all_pairs_at_any_population_count(spark, tile):
    """Points of one key with counts from 0 to 512 and small sets, all of one shingle set, against each pair's own distance."""
    rng, rows, h = np.random.default_rng(6), [], np.arange(1, 21, dtype=np.int64)
    for i in range(80):
        bits = rng.random(512) < rng.choice([0.0, 0.1, 0.3, 0.5, 0.9, 1.0])
        size = 20 if i % 8 else 6
        rows.append((i, bytearray(np.packbits(bits).tobytes()), int(bits.sum()) if size == 20 else similar.UNCOUNTED, [7], size, i, bytearray(h[:size].tobytes())))
    points = spark.createDataFrame([r[:6] for r in rows], "mark long, print binary, ones long, keys array<long>, size long, label long")
    sets = spark.createDataFrame([(r[0], r[6]) for r in rows], "m long, own binary")
    got = sorted(map(tuple, similar.candidates(points, sets, 0.8, tile).collect()))
    apart = lambda p, q: (int.from_bytes(p[1], "big") ^ int.from_bytes(q[1], "big")).bit_count()
    want = [(p[0], q[0]) for p, q in itertools.combinations(rows, 2) if p[4] == q[4] and (p[4] == 6 or apart(p, q) <= similar.reach(0.8))]
    assert got == want and any(r[2] == 512 for r in rows) and any(r[2] == 0 for r in rows)

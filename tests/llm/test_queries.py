"""The registered queries, over whole tables with edge cases, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("vecloom.llm")
from vecloom.llm import registry  # noqa: E402

from .conftest import CLASH, WORDS, text  # noqa: E402
from .test_llm import brute_components, brute_fingerprint, brute_leaks, brute_repeats, brute_search, brute_spans, reference_tokens, split, targets  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, edge_docs):
    """A folder of tables; ids of documents are unique but for rows that are equal, and for one null."""
    folder, rng = tmp_path_factory.mktemp("tables"), random.Random(21)
    items = [(i, text(rng, "en", n)) for i, n in enumerate((3, 8, 30))] + [(9, None), (10, "")]
    docs = []
    for i in range(20, 90):
        lang = rng.choice(sorted(WORDS))
        body = text(rng, lang, rng.choice([1, 4, 25, 80]))
        body += rng.choice(["", "", " <|endoftext|> and", " call +49 170 1234567.", " me@mail.com 10.0.0.256", f" {items[1][1]}", f" {items[2][1]}", "\n4111 1111 1111 1111"])
        docs.append((i, body, lang, rng.choice(["a", "b", "é", None]), len(body)))
    docs += [(100 + k, docs[k][1], docs[k][2], "copies", 0) for k in range(15)] + [(120, docs[3][1] + " " + docs[4][1] * 2, "en", "a", 0)]
    docs += [(0, None, "en", "b", None), (1, "", None, None, 0), (2, " \t\n ", "de", "b", 4), (3, "½ ² Ⅷ ① 12", "en", "a", 1), (4, "中", "fr", "a", 1), (5, "x" * 30_000, "en", "c", 1), (None, "no id here, just words", "en", None, 1)]
    clash = ("c", "c", 7, "c", "c", "c", 0.5, "c", "c", 3, 4, "c", "c", "c")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, "

    def put(name, rows, schema, parts=3):
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{folder}/{name}.parquet")

    put("documents", [r + clash for r in docs], kinds + CLASH)
    put("benchmark", items, "item_id long, text string")
    put("labels", [(i, i % 2, 0) for i in range(20, 60)], "doc_id long, quality int, toxic int")
    html = {0: None, 1: "", 2: "short", 3: "short", 4: "page " * 30, 5: "page " * 30, 6: "é" * 20_000, 7: "page " * 30}
    put("pages", [(i, f"http://e/{i}", h, "c") for i, h in html.items()], "page_id long, url string, html string, digest string")
    vectors = [(i, [rng.choice([-1, 1]) * rng.random() * rng.choice([1, 1e6]) for _ in range(5)]) for i in range(120)]
    put("embeddings", [*((i, v, 1) for i, v in vectors), (200, None, 1), (250, [1.0, None], 1), (300, [math.nan], 1), (350, [math.inf], 1)], "vec_id long, embedding array<double>, label int")
    return str(folder), docs, items, html, vectors


def run(spark, tables, name):
    df = registry.queries()[name](spark, tables[0])
    return df.columns, [tuple(r) for r in df.collect()]


def test_op1(spark, tables):
    _, rows = run(spark, tables, "op1_warc")
    want = []
    for i, h in tables[3].items():
        data = (h or "").encode()
        first = min(j for j, o in tables[3].items() if (o or "") == (h or "")) if len(data) >= 100 else i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    assert sorted(rows) == want


def test_op2(spark, tables):
    columns, rows = run(spark, tables, "op2_cover_tree")
    assert columns == ["query_id", "rank", "vec_id", "score"] and set(rows) == brute_search(tables[4], 5, 50) and len(rows) == 15


def test_op3(spark, tables):
    _, rows = run(spark, tables, "op3_simhash")
    prints = [brute_fingerprint(d[1]) for d in tables[1]]
    want = zip([d[0] for d in tables[1]], [f"{p:016x}" for p in prints], brute_components(prints, [d[0] for d in tables[1]]))
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_op4(spark, tables):
    columns, rows = run(spark, tables, "op4_mixing")
    size, by_id = Counter(), {}
    for i, t, _, s, _ in tables[1]:
        size[s] += len(split(t))
        by_id[i] = (len(split(t)), s)
    goal, taken, most = targets(size), Counter(), Counter()
    assert columns == ["doc_id", "size", "source_size", "target", "taken"] and len(rows) == len(tables[1])
    for doc_id, n, total, target, took in rows:
        own, source = by_id[doc_id]
        assert n == own and total == size[source] and target == pytest.approx(goal[source]) and took <= 3 * n and (n == 0 or took % n == 0)
        taken[source] += took
        most[source] = max(most[source], n)
    assert all(abs(taken[s] - goal[s]) <= most[s] + 1e-6 for s in size)
    assert sorted(map(str, rows)) == sorted(map(str, run(spark, tables, "op4_mixing")[1]))


def test_op5(spark, tables):
    columns, rows = run(spark, tables, "op5_language")
    by_id = {d[0]: d for d in tables[1]}
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == len(tables[1])
    for doc_id, held, lang, score, _ in rows:
        assert held == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2) and 0 <= score <= 1
        blank = not any(c.isalpha() for c in by_id[doc_id][1] or "")
        assert (lang == "und") == blank and (blank or lang in ("de", "en", "fr"))
    long = [(lang, by_id[i][2]) for i, held, lang, _, _ in rows if held and len(split(by_id[i][1])) >= 25 and i not in (5,)]
    assert sum(a == b for a, b in long) >= 0.9 * len(long)


def test_op6(spark, tables):
    columns, rows = run(spark, tables, "op6_resample")
    n = sum(r[3] for r in rows)
    assert columns == ["doc_id", "log_weight", "key", "selected"] and len(rows) == len(tables[1]) and n >= round(len(rows) / 2)
    cut = min(r[2] for r in rows if r[3])
    assert all(r[3] == (r[2] >= cut) for r in rows)


def test_op7(spark, tables):
    _, rows = run(spark, tables, "op7_token_file")
    docs = sorted(((d[0], d[1]) for d in tables[1]), key=lambda d: (d[0] is not None, d[0] or 0))
    want, start = [], 0
    for (doc_id, _), ids in zip(docs, reference_tokens([t for _, t in docs])):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows, key=lambda r: r[1]) == want and any("<|endoftext|>" in (t or "") for _, t in docs)


def test_op8(spark, tables):
    _, rows = run(spark, tables, "op8_leaks")
    want = brute_leaks([(d[0], d[1]) for d in tables[1]], tables[2])
    assert sorted(str(r[:5]) for r in rows) == want and len(want) > 5


def test_op9(spark, tables):
    columns, rows = run(spark, tables, "op9_privacy")
    by_id = {d[0]: d[1] for d in tables[1]}
    assert columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and len(rows) == len(tables[1])
    for doc_id, *n, digest, spans in rows:
        base = brute_spans(by_id[doc_id])
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert n == [kinds[k] for k in ("email", "ip", "card", "phone")], (doc_id, by_id[doc_id][-90:], base)
        assert digest == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(x for x in spans.split(",") if not x.startswith("term")) == base
    assert sum(sum(r[1:5]) for r in rows) > 10


def test_op10(spark, tables):
    _, rows = run(spark, tables, "op10_repeats")
    docs = sorted(((d[0], d[1]) for d in tables[1]), key=lambda d: (d[0] is not None, d[0] or 0))
    assert {r[0]: r[1:] for r in rows} == brute_repeats(docs, 20) and sum(r[2] for r in rows) > 100

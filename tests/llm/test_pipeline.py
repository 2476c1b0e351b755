"""The pipeline, stage by stage against brute force, and as a whole."""

import os
import zlib

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("vecloom.llm")
import corpus_pipeline  # noqa: E402
from vecloom.llm import registry  # noqa: E402

from .test_llm import brute_leaks, reference_tokens, targets  # noqa: E402
from .test_similar import exact_groups  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, before, stage = docs.columns, docs.collect(), dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontaminate", "mix", "tokens"]

    def step(name, df):
        out = stage[name](spark, df, DATA)
        assert name == "tokens" or out.columns == names
        return spark.createDataFrame(out.collect(), out.schema)

    df = step("language", docs)
    assert df.count() == len(before)  # all have a clear language
    df2 = step("near_copies", df)
    rows = df.collect()
    part = exact_groups([(r["doc_id"], r["text"]) for r in rows])
    assert sorted(r["doc_id"] for r in df2.collect()) == sorted(set(part.values()))
    df3 = step("decontaminate", df2)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [(r["doc_id"], r["text"]) for r in df2.collect()]
    leaked = {int(x[1:].split(",")[0]) for x in brute_leaks(texts, items)}
    assert leaked and sorted(r["doc_id"] for r in df3.collect()) == sorted(i for i, _ in texts if i not in leaked)
    df4 = step("mix", df3)
    size, taken = {}, {}
    for r in df3.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"].encode().split())
    for r in df4.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].encode().split())
    longest = max(len(r["text"].encode().split()) for r in df3.collect())
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in targets(size).items())
    rows = sorted(((r["doc_id"], r["text"]) for r in df4.collect()), key=lambda r: (r[0], r[1].encode()))
    want, start = [], 0
    for (i, _), ids in zip(rows, reference_tokens([t for _, t in rows])):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, step("tokens", df4).collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()), key=lambda r: r[1]) == want


def test_stages_take_edge_cases_and_nothing(spark, edge_docs):
    for df in (edge_docs, edge_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, DATA)
            assert out.count() >= 0 and (name == "tokens" or out.columns == edge_docs.columns)
    once = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, edge_docs, DATA).collect()]
    assert len(once) == len(set(once)) and sum(i == 1 for i, _ in once) == 2  # two texts under one id are two documents


def test_registered_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for x in os.listdir(DATA):
        con.execute(f"CREATE VIEW {x.split('.')[0]} AS SELECT * FROM '{DATA}/{x}'")
    assert set(registry.queries()) == {f"op{n}_{x}" for n, x in enumerate("warc cover_tree simhash mixing language resample token_file leaks privacy repeats".split(), 1)}
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, DATA).toPandas()
        want = con.execute(sql).df()
        plain = lambda df: sorted(str([None if pd.isna(v) else v for v in r]) for r in df[sorted(df)].astype(object).values.tolist())
        assert plain(got) == plain(want), name

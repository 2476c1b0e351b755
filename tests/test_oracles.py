"""Every query of the array and matrix operators against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from vecloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for x in os.listdir(DATA):
        con.execute(f"CREATE VIEW {x.split('.')[0]} AS SELECT * FROM '{DATA}/{x}'")
    return con


def rows(df):
    def plain(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want)
    assert [str(got[c].dtype) for c in sorted(got)] == [str(want[c].dtype) for c in sorted(want)]
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_histogram_matches_sql_beside_bin_edges(spark, tmp_path):
    edges = [10.0 * k for k in range(51)]
    beside = [math.nextafter(v, to) for v in edges for to in (-math.inf, math.inf)]
    values = [*edges, *beside, *(v / 100 for v in range(0, 50100, 7)), None, math.nan, math.inf, -math.inf, -0.0, -0.01]
    spark.createDataFrame([(v,) for v in values], "value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = registry.queries()["histogram_even"](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()["histogram_even"]).df()
    assert rows(got) == rows(want)

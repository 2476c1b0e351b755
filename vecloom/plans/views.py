"""The vectors, matrices and permutations that the queries take from the tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.sparse import SparseTable

#: Ids of a block when all of a range are listed.
BLOCK = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balances(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))


def events(spark, d) -> DataFrame:
    v = F.when(F.col("event_id") % 2 == 0, -F.col("value")).otherwise(F.col("value"))
    return table(spark, d, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("seg"), v.alias("v"))


def sizes(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").alias("v"))


def prices(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))


def segments(spark, d) -> DataFrame:
    """Every user id up to one past the largest, so one segment is empty."""
    top = table(spark, d, "events").agg(F.max("user_id").alias("m"))
    blocks = top.select("m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") + 1) / BLOCK).cast("long"))).alias("b"))
    ids = F.sequence(F.col("b") * BLOCK, F.least(F.col("b") * BLOCK + (BLOCK - 1), F.col("m") + 1))
    return blocks.select(F.explode(ids).alias("seg"))


def side(spark, d) -> int:
    """Orders are numbered from 0, and there are more of them than parts or suppliers. Read from the file's footer."""
    return table(spark, d, "orders").count()


def matrix(spark, d, which: str = "a") -> SparseTable:
    """All line items: quantities by order and part, or by order and supplier, signed by line."""
    val = F.col("l_quantity") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    col = F.col("l_partkey" if which == "a" else "l_suppkey")
    df = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row"), col.alias("col")).agg(F.sum(val).alias("val"))
    n = side(spark, d)
    return SparseTable(df, n, n, "row_major")


def nations(spark, d) -> SparseTable:
    """Customers by nation and region: a matrix that is small whatever the number of customers."""
    region = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("row"), F.col("n_regionkey").cast("long").alias("col"))
    held = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("_n")).agg(F.count("*").cast("double").alias("val"))
    df = region.join(held, F.col("row") == F.col("_n")).select("row", "col", "val")
    return SparseTable(df, table(spark, d, "nation").count(), table(spark, d, "region").count(), "row_major")


def permutation(spark, d, k: int, c: int) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("i"))
    return p.select("i", ((F.col("i") * k + c) % p.agg(F.count("*")).scalar()).alias("p"))


def tuples(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


CUST = "SELECT c_custkey AS i, c_acctbal AS v FROM customer"
EV = "SELECT event_id AS i, user_id AS seg, CASE WHEN event_id % 2 = 0 THEN -value ELSE value END AS v FROM events"
PINT = "SELECT p_partkey AS i, p_size AS v FROM part"
PRICE = "SELECT p_partkey AS i, p_retailprice AS v FROM part"
SEG = "SELECT unnest(range(0, (SELECT max(user_id) + 2 FROM events))) AS seg"
EMB = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings"


SIDE = "(SELECT count(*) FROM orders)"
NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS r, CAST(n_regionkey AS BIGINT) AS c, CAST(count(*) AS DOUBLE) AS val FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"


def matrix_sql(which: str = "a") -> str:
    col = "l_partkey" if which == "a" else "l_suppkey"
    return f"SELECT l_orderkey AS r, {col} AS c, sum(l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) AS val FROM lineitem GROUP BY 1, 2"


def perm_sql(k: int, c: int) -> str:
    return f"SELECT p_partkey AS i, (p_partkey * {k} + {c}) % (SELECT count(*) FROM part) AS p FROM part"

"""Every query of the array and matrix operators with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import scalars as X
from vecloom.functions import tuples as T
from vecloom.operators import convert, csr, elementwise, grouping, histogram, movement, permutation, reduction, selection, sorting, sparse, topk
from vecloom.plans import views as V
from vecloom.sources import generators as G
from vecloom.sources import matrix_market

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def coords(df: DataFrame, *values: str) -> DataFrame:
    """Matrix rows under the names that the SQL uses."""
    return df.select(F.col("row").alias("r"), F.col("col").alias("c"), *(values or ("val",)))


# Top-k


@query("topk_abs", f"SELECT i, v FROM (SELECT *, rank() OVER (ORDER BY abs(v) DESC) AS k FROM ({V.CUST})) WHERE k <= 36")
def _(s, d):
    return topk.k_largest_abs(V.balances(s, d), 36)


@query("topk_abs_ties", f"SELECT i, v FROM (SELECT *, rank() OVER (ORDER BY abs(v) DESC) AS k FROM ({V.PINT})) WHERE k <= 10")
def _(s, d):
    return topk.k_largest_abs(V.sizes(s, d), 10)


@query("topk_abs_grouped", f"SELECT seg, i, v FROM (SELECT *, rank() OVER (PARTITION BY seg ORDER BY abs(v) DESC) AS k FROM ({V.EV})) WHERE k <= 3")
def _(s, d):
    return topk.k_largest_abs(V.events(s, d), 3, "seg")


@query("topk_threshold", f"SELECT min(a) AS threshold FROM (SELECT abs(v) AS a FROM ({V.CUST}) ORDER BY a DESC LIMIT 36)")
def _(s, d):
    return topk.threshold_abs(V.balances(s, d), 36)


@query("topk_threshold_grouped", f"SELECT seg, min(abs(v)) AS threshold FROM (SELECT *, rank() OVER (PARTITION BY seg ORDER BY abs(v) DESC) AS k FROM ({V.EV})) WHERE k <= 3 GROUP BY seg")
def _(s, d):
    return topk.threshold_abs(V.events(s, d), 3, "seg")


@query("topk_strict", f"SELECT i, v FROM ({V.EV}) ORDER BY abs(v) DESC, i LIMIT 36")
def _(s, d):
    return topk.k_largest_abs_strict(V.events(s, d), 36)


# Sources


@query("iota", "SELECT i, i + 7 AS v FROM (SELECT unnest(range(0, (SELECT count(*) FROM part))) AS i)")
def _(s, d):
    return G.iota(s, V.sizes(s, d).count(), 7)


@query("fill", "SELECT p_partkey AS i, CAST(2.5 AS DOUBLE) AS v FROM part")
def _(s, d):
    return G.fill(V.sizes(s, d), 2.5)


# Random numbers of two engines agree in distribution only: number, range, mean and deviation of a whole vector, the moments
# within six standard errors. Two members of a pair are uncorrelated.

DRAWS = 200_000


def moments(df: DataFrame, mean: float, deviation: float, low: float | None = None, high: float | None = None) -> DataFrame:
    six = 6 / DRAWS**0.5
    v = F.col("v")
    inside = F.lit(True) if low is None else (F.min(v) >= low) & (F.lit(True) if high is None else F.max(v) < high)
    near = [(F.abs(F.avg(v) - mean) < six * deviation).alias("mean_ok"), (F.abs(F.stddev(v) / deviation - 1) < 3 * six).alias("deviation_ok")]
    return df.agg(F.count("*").alias("n"), F.count_distinct(v).alias("d"), inside.alias("range_ok"), *near).select("n", (F.col("d") > 0.99 * DRAWS).alias("distinct_ok"), "range_ok", "mean_ok", "deviation_ok")


MOMENTS = f"SELECT CAST({DRAWS} AS BIGINT) AS n, true AS distinct_ok, true AS range_ok, true AS mean_ok, true AS deviation_ok"
BOTH = f"{MOMENTS}, true AS apart_ok, 're' AS member UNION ALL {MOMENTS}, true, 'im'"


def both_moments(df: DataFrame, *args: float) -> DataFrame:
    apart = df.agg((F.abs(F.corr("v.re", "v.im")) < 6 / DRAWS**0.5).alias("apart_ok"))
    parts = [moments(df.select(F.col(f"v.{m}").alias("v")), *args).withColumns({"apart_ok": apart.scalar(), "member": F.lit(m)}) for m in ("re", "im")]
    return parts[0].unionByName(parts[1])


@query("rand_uniform", MOMENTS)
def _(s, d):
    return moments(G.uniform_real(s, DRAWS, -3.0, 5.0, 1), 1.0, 8 / 12**0.5, -3.0, 5.0)


@query("rand_normal", MOMENTS)
def _(s, d):
    return moments(G.normal_real(s, DRAWS, 2.0, 3.0, 1), 2.0, 3.0)


@query("rand_uniform_complex", BOTH)
def _(s, d):
    return both_moments(G.uniform_complex(s, DRAWS, -1.0, 1.0, 1), 0.0, 2 / 12**0.5, -1.0, 1.0)


@query("rand_normal_complex", BOTH)
def _(s, d):
    return both_moments(G.normal_complex(s, DRAWS, 0.0, 1.0, 1), 0.0, 1.0)


@query("rand_exponential", MOMENTS)
def _(s, d):
    return moments(G.generate(s, DRAWS, lambda u: -F.log(F.lit(1.0) - u), 1), 1.0, 1.0, 0.0)


@query("vector_from_values", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(1.5 AS DOUBLE)), (1, -2.0), (2, 4.25)) t(i, v)")
def _(s, d):
    return G.from_values(s, [1.5, -2.0, 4.25])


# Element-wise

ORDER_SUMS = "SELECT o_custkey AS i, sum(o_totalprice) AS v FROM orders GROUP BY 1"
PAIR = f"SELECT x.i, x.v AS x, coalesce(y.v, 0) AS y FROM ({V.CUST}) x LEFT JOIN ({ORDER_SUMS}) y ON x.i = y.i"


def order_sums(s, d) -> DataFrame:
    sums = V.table(s, d, "orders").groupBy(F.col("o_custkey").alias("i")).agg(F.sum("o_totalprice").alias("t"))
    return V.balances(s, d).select("i").join(sums, "i", "left").select("i", F.coalesce("t", F.lit(0.0)).alias("v"))


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("transform", f"SELECT i, v * v + 1 AS v FROM ({V.CUST})")
def _(s, d):
    return elementwise.transform(V.balances(s, d), lambda v: v * v + 1)


@query("axpy", f"SELECT i, round(2.5 * x + y, 4) AS v FROM ({PAIR})")
def _(s, d):
    return rounded(elementwise.axpy(2.5, V.balances(s, d), order_sums(s, d)), "v", digits=4)


@query("axmy", f"SELECT i, round(2.0 * x * y / 1e6, 3) AS v FROM ({PAIR})")
def _(s, d):
    return elementwise.axmy(2.0, V.balances(s, d), order_sums(s, d)).select("i", F.round(F.col("v") / 1e6, 3).alias("v"))


@query("copy_cast", f"SELECT i, CAST(trunc(v) AS BIGINT) AS v FROM ({V.CUST})")
def _(s, d):
    return elementwise.copy(V.balances(s, d), "bigint")


def exploded(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("a").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), "v")


def exploded_sql(expr: str) -> str:
    return f"SELECT vec_id, unnest(range(0, len(a))) AS pos, unnest(a) AS v FROM (SELECT vec_id, {expr} AS a FROM ({V.EMB}))"


@query("array_transform", exploded_sql("list_transform(a, lambda x: x * 2 + 1)"))
def _(s, d):
    return exploded(V.tuples(s, d).withColumn("a", T.array_transform(F.col("a"), lambda x: x * 2 + 1)))


for _op, _name in (("+", "plus"), ("-", "minus"), ("*", "times"), ("/", "over")):

    def _tuple(s, d, op=_op):
        b = F.transform("a", lambda x: F.abs(x) + 1)
        return exploded(V.tuples(s, d).withColumn("a", T.combine(F.col("a"), b, op)))

    def _scalar(s, d, op=_op):
        return exploded(V.tuples(s, d).withColumn("a", T.with_scalar(F.col("a"), F.lit(3.5), op)))

    query(f"tuple_{_name}_tuple", exploded_sql(f"list_transform(a, lambda x: x {_op} (abs(x) + 1))"))(_tuple)
    query(f"tuple_{_name}_scalar", exploded_sql(f"list_transform(a, lambda x: x {_op} 3.5)"))(_scalar)


@query("scalar_times_tuple", exploded_sql("list_transform(a, lambda x: 3.5 * x)"))
def _(s, d):
    return exploded(V.tuples(s, d).withColumn("a", T.with_scalar(F.col("a"), F.lit(3.5), "*", scalar_first=True)))


@query("scalar_plus_tuple", exploded_sql("list_transform(a, lambda x: 3.5 + x)"))
def _(s, d):
    return exploded(V.tuples(s, d).withColumn("a", T.with_scalar(F.col("a"), F.lit(3.5), "+", scalar_first=True)))


@query("struct_array_roundtrip", f"SELECT vec_id, a[1] AS x, a[2] AS y, a[3] AS z FROM ({V.EMB})")
def _(s, d):
    st = V.tuples(s, d).select("vec_id", T.array_to_struct(F.col("a"), 3).alias("t"))
    back = st.select("vec_id", T.struct_to_array(F.col("t"), st.schema["t"].dataType).alias("b"))
    return back.select("vec_id", F.col("b")[0].alias("x"), F.col("b")[1].alias("y"), F.col("b")[2].alias("z"))


def part_tuple(s, d) -> DataFrame:
    return V.table(s, d, "part").select(F.col("p_partkey").alias("i"), F.struct(F.col("p_partkey").alias("x"), F.col("p_size").alias("y"), F.col("p_retailprice").alias("z")).alias("t"))


@query("tuple_transform", "SELECT p_partkey AS i, p_partkey * 3 AS x, CAST(p_size * 3 AS INTEGER) AS y, p_retailprice * 3 AS z FROM part")
def _(s, d):
    df = part_tuple(s, d)
    return df.select("i", T.assign(lambda v: v * 3, df.schema["t"].dataType, F.col("t")).alias("t")).select("i", "t.*")


@query("tuple_for_each_n", "SELECT p_partkey AS i, p_partkey + 1 AS x, CAST(p_size + 1 AS INTEGER) AS y, p_retailprice AS z FROM part")
def _(s, d):
    df = part_tuple(s, d)
    return df.select("i", T.assign(lambda v: v + 1, df.schema["t"].dataType, F.col("t"), 2).alias("t")).select("i", "t.*")


@query("tuple_for_each_pair", "SELECT p_partkey AS i, p_partkey + p_size AS x, CAST(p_size + p_size AS INTEGER) AS y, p_retailprice + p_size AS z FROM part")
def _(s, d):
    df = part_tuple(s, d).withColumn("u", F.struct(F.col("t.y").alias("a"), F.col("t.y").alias("b"), F.col("t.y").alias("c")))
    return df.select("i", T.assign_pairwise(lambda a, b: a + b, df.schema["t"].dataType, F.col("t"), F.col("u"), ["a", "b", "c"]).alias("t")).select("i", "t.*")


@query("multi_vector", f"SELECT a.i, a.v AS x, b.v AS y, a.v * b.v AS z FROM ({V.PINT}) a JOIN ({V.PRICE}) b ON a.i = b.i")
def _(s, d):
    return elementwise.multi({"x": V.sizes(s, d), "y": V.prices(s, d)}).withColumn("z", F.col("x") * F.col("y"))


@query("multi_offsets", f"SELECT a.i, a.v AS x, b.v AS y, c.v AS z FROM ({V.PINT}) a JOIN ({V.PINT}) b ON b.i = a.i - 1 JOIN ({V.PRICE}) c ON c.i = a.i + 2")
def _(s, d):
    return elementwise.multi({"x": V.sizes(s, d), "y": V.sizes(s, d), "z": V.prices(s, d)}, {"y": -1, "z": 2})


@query("ranges_equal", f"SELECT bool_and(x.v = y.v) AS equal FROM ({V.CUST}) x JOIN ({V.CUST}) y ON x.i = y.i")
def _(s, d):
    return elementwise.equal(V.balances(s, d), V.balances(s, d))


@query("ranges_differ", f"SELECT bool_and(x.v = y.v + 1) AS equal FROM ({V.CUST}) x JOIN ({V.CUST}) y ON x.i = y.i")
def _(s, d):
    return elementwise.equal(V.balances(s, d), elementwise.transform(V.balances(s, d), lambda v: v + 1))


@query("coo_equal", f"SELECT count(*) = 0 AS equal FROM (({V.matrix_sql()}) EXCEPT ALL ({V.matrix_sql()}))")
def _(s, d):
    return sparse.equal(V.matrix(s, d), V.matrix(s, d), ordered=True)


@query("coo_differ", f"SELECT count(*) = 0 AS equal FROM (({V.matrix_sql()}) EXCEPT ALL ({V.matrix_sql('b')}))")
def _(s, d):
    return sparse.equal(V.matrix(s, d), V.matrix(s, d, "b"))


# Movement

PERM_A = V.perm_sql(7, 3)


def as_index(p: DataFrame) -> DataFrame:
    return p.select("i", F.col("p").alias("v"))


@query("gather", f"SELECT m.i, s.v FROM ({PERM_A}) m JOIN ({V.PRICE}) s ON m.p = s.i")
def _(s, d):
    return movement.gather(as_index(V.permutation(s, d, 7, 3)), V.prices(s, d))


@query("scatter", f"SELECT d.i, coalesce(n.v, -1.0) AS v FROM ({V.PRICE}) d LEFT JOIN (SELECT i % 100 AS at, arg_max(v, i) AS v FROM ({V.PRICE}) GROUP BY 1) n ON d.i = n.at")
def _(s, d):
    p = V.prices(s, d)
    return movement.scatter(p, p.select("i", (F.col("i") % 100).alias("v")), G.fill(p, -1.0))


@query("copy_find", f"SELECT min(i) AS pos FROM ({V.PINT}) WHERE v = 17")
def _(s, d):
    return movement.find(V.sizes(s, d), 17)


@query("copy_find_absent", "SELECT CAST(-5 AS BIGINT) AS pos")
def _(s, d):
    return movement.find(V.sizes(s, d), 100_000, -5)


@query("block_copy_2d", f"SELECT (i // 20) * 15 + i % 20 AS i, v FROM ({V.PINT}) WHERE i % 20 < 12")
def _(s, d):
    return movement.block_copy(V.sizes(s, d), 1 << 40, 12, 20, 12, 15)


@query("block_copy_functor", f"SELECT (i // 20) * 12 + i % 20 AS i, CAST(v * 2 AS INTEGER) AS v FROM ({V.PINT}) WHERE i % 20 < 12")
def _(s, d):
    return movement.block_copy(V.sizes(s, d), 1 << 40, 12, 20, 12, 12, lambda v: v * 2)


@query("span_split", f"SELECT CASE WHEN i < 50 THEN 0 ELSE 1 END AS src, CASE WHEN i < 50 THEN i ELSE i - 50 END AS i, v FROM ({V.CUST})")
def _(s, d):
    return movement.spans(*movement.split_at(V.balances(s, d), 50))


@query("prefetch", V.PINT)
def _(s, d):
    return movement.prefetch(V.sizes(s, d))


# Selection


@query("select_if", f"SELECT row_number() OVER (ORDER BY i) - 1 AS pos, v FROM ({V.EV}) WHERE v > 100")
def _(s, d):
    return selection.select_if(V.events(s, d), lambda v: v > 100)


@query("select_if_with_index", f"SELECT row_number() OVER (ORDER BY i) - 1 AS pos, v, i FROM ({V.EV}) WHERE v > 50 AND i % 3 = 0")
def _(s, d):
    return selection.select_if_with_index(V.events(s, d), lambda v, i: (v > 50) & (i % 3 == 0))


@query("count_selected", f"SELECT count(*) AS n FROM ({V.EV}) WHERE v > 100")
def _(s, d):
    return selection.count_selected(V.events(s, d), lambda v: v > 100)


# Reductions and scans


@query("reduce_sum", f"SELECT round(10.0 + sum(v), 2) AS v FROM ({V.EV})")
def _(s, d):
    return rounded(reduction.reduce(V.events(s, d), "sum", 10.0), "v", digits=2)


@query("reduce_min", f"SELECT least(-1.0, min(v)) AS v FROM ({V.EV})")
def _(s, d):
    return reduction.reduce(V.events(s, d), "min", -1.0)


@query("reduce_max", f"SELECT greatest(1.0, max(v)) AS v FROM ({V.EV})")
def _(s, d):
    return reduction.reduce(V.events(s, d), "max", 1.0)


@query("reduce_empty", "SELECT CAST(4.5 AS DOUBLE) AS v")
def _(s, d):
    return reduction.reduce(V.events(s, d).filter("i < 0"), "sum", 4.5)


@query("segmented_reduce", f"SELECT s.seg, coalesce(greatest(5.0, max(e.v)), 5.0) AS v FROM ({V.SEG}) s LEFT JOIN ({V.EV}) e ON s.seg = e.seg GROUP BY s.seg")
def _(s, d):
    return reduction.segmented_reduce(V.events(s, d), V.segments(s, d), "max", 5.0)


# Segments of 100 elements each over the whole vector, and an empty one behind each.
BLOCKS = "SELECT seg, (seg + 1) // 2 * 100 AS lo, (seg // 2 + 1) * 100 AS hi FROM (SELECT unnest(range(0, (SELECT 2 * (count(*) // 100 + 1) FROM part))) AS seg)"


def blocks(s, d) -> DataFrame:
    n = V.table(s, d, "part").count()
    half = lambda c: F.floor(c / 2).cast("long")
    seg = F.col("id")
    return s.range(2 * (n // 100 + 1)).select(seg.alias("seg"), (half(seg + 1) * 100).alias("lo"), ((half(seg) + 1) * 100).alias("hi"))


@query("segmented_reduce_pointers", f"SELECT s.seg, CAST(coalesce(sum(e.v), 0) + 1 AS BIGINT) AS v FROM ({BLOCKS}) s LEFT JOIN ({V.PINT}) e ON e.i >= s.lo AND e.i < s.hi GROUP BY s.seg")
def _(s, d):
    b = blocks(s, d)
    return reduction.segmented_reduce(reduction.by_pointers(V.sizes(s, d), b), b, "sum", 1)


# (a, b) then (c, d): apply a * x + b, then c * x + d. Associative, and order matters.
def affine(a: Column, b: Column) -> Column:
    return F.struct((a["a"] * b["a"]).alias("a"), (a["b"] * b["a"] + b["b"]).alias("b"))


def maps(x: DataFrame) -> DataFrame:
    """Halve and add v, as maps."""
    return x.withColumn("v", F.struct(F.lit(0.5).alias("a"), F.col("v").cast("double").alias("b")))


@query("reduce_function", f"SELECT round(sum(v * pow(0.5, n - k)), 6) AS v FROM (SELECT v, row_number() OVER (ORDER BY i) AS k, count(*) OVER () AS n FROM ({V.PINT}))")
def _(s, d):
    whole = reduction.tree_fold(maps(V.sizes(s, d).select("i", "v")), affine)
    return whole.select(F.round("v.b", 6).alias("v"))


@query("reduce_function_init", f"SELECT CAST(bit_xor(v) AS INTEGER) AS v FROM (SELECT v FROM ({V.PINT}) UNION ALL SELECT 5)")
def _(s, d):
    return reduction.reduce(V.sizes(s, d), lambda a, b: a.bitwiseXOR(b), 5)


@query("segmented_reduce_function", f"SELECT g.seg, CAST(coalesce(xor(3, bit_xor(CAST(trunc(e.v) AS BIGINT))), 3) AS BIGINT) AS v FROM ({V.SEG}) g LEFT JOIN ({V.EV}) e ON g.seg = e.seg GROUP BY g.seg")
def _(s, d):
    x = V.events(s, d).withColumn("v", F.col("v").cast("long"))
    return reduction.segmented_reduce(x, V.segments(s, d), lambda a, b: a.bitwiseXOR(b), F.lit(3).cast("long"))


@query("inclusive_scan_function", f"SELECT e.i, round(sum(p.v * pow(0.5, e.i - p.i)), 6) AS v FROM ({V.PINT}) e JOIN ({V.PINT}) p ON p.i <= e.i AND p.i > e.i - 60 GROUP BY e.i")
def _(s, d):
    return reduction.inclusive_scan(maps(V.sizes(s, d)), affine).select("i", F.round("v.b", 6).alias("v"))


@query("fold_ordered", f"SELECT seg, round(sum(v * pow(0.5, n - k)), 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY i) AS k, count(*) OVER (PARTITION BY seg) AS n FROM ({V.EV})) GROUP BY seg")
def _(s, d):
    return rounded(reduction.fold_ordered(V.events(s, d), lambda a, v: a * 0.5 + v, F.lit(0.0), "seg"), "v", digits=6)


@query("sum_columns", f"SELECT i % 20 AS i, CAST(sum(v) AS BIGINT) AS v FROM ({V.PINT}) GROUP BY 1")
def _(s, d):
    return reduction.sum_columns(V.sizes(s, d), 20)


@query("finite_stats", f"SELECT count(*) FILTER (WHERE isfinite(w)) AS finite, avg(CASE WHEN isfinite(w) THEN 1.0 ELSE 0.0 END) AS fraction FROM (SELECT CASE WHEN i % 97 = 0 THEN CAST('nan' AS DOUBLE) WHEN i % 97 = 1 THEN CAST('inf' AS DOUBLE) WHEN i % 97 = 2 THEN CAST('-inf' AS DOUBLE) ELSE v END AS w FROM ({V.EV}))")
def _(s, d):
    bad = {0: "nan", 1: "inf", 2: "-inf"}
    v = F.col("v")
    for k, x in bad.items():
        v = F.when(F.col("i") % 97 == k, F.lit(float(x))).otherwise(v)
    return reduction.finite_stats(V.events(s, d).withColumn("v", v))


RUNNING = "OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("inclusive_scan_sum", f"SELECT i, CAST(sum(v) {RUNNING} AS BIGINT) AS v FROM ({V.PINT})")
def _(s, d):
    return reduction.inclusive_scan(V.sizes(s, d), "sum")


@query("inclusive_scan_max", f"SELECT i, max(v) {RUNNING} AS v FROM ({V.EV})")
def _(s, d):
    return reduction.inclusive_scan(V.events(s, d), "max")


@query("inclusive_scan_min", f"SELECT i, min(v) {RUNNING} AS v FROM ({V.EV})")
def _(s, d):
    return reduction.inclusive_scan(V.events(s, d), "min")


@query("inclusive_scan_product", f"SELECT i, round(product(1 + v / 1e6) {RUNNING}, 6) AS v FROM ({V.PINT})")
def _(s, d):
    x = elementwise.transform(V.sizes(s, d), lambda v: 1 + v / 1e6)
    return rounded(reduction.inclusive_scan(x, "product"), "v", digits=6)


# Histograms


@query("histogram_even", "SELECT b.bin, count(e.x) AS n FROM (SELECT unnest(range(0, 50)) AS bin) b LEFT JOIN (SELECT value AS x, CAST(floor(value / 500.0 * 50) AS BIGINT) AS bin FROM events WHERE value >= 0 AND value < 500) e ON b.bin = e.bin GROUP BY b.bin")
def _(s, d):
    return histogram.even(V.table(s, d, "events").select(F.col("value").alias("v")), 50, 0.0, 500.0)


BINS = "SELECT b.bin, count(e.bin) AS n FROM (SELECT unnest(range(0, 256)) AS bin) b LEFT JOIN ({}) e ON b.bin = e.bin GROUP BY b.bin"


@query("bin_values256", BINS.format("SELECT (o_orderkey >> 8) & 255 AS bin FROM orders WHERE o_orderkey >> 16 = 0"))
def _(s, d):
    return histogram.bytes256(V.table(s, d, "orders").select(F.col("o_orderkey").alias("bits")), 32, 16, 0)


@query("bin_values256_map", BINS.format("SELECT 255 - (o_orderkey & 255) AS bin FROM orders WHERE o_orderkey >> 8 = 3"))
def _(s, d):
    return histogram.bytes256(V.table(s, d, "orders").select(F.col("o_orderkey").alias("bits")), 32, 24, 3, lambda b: 255 - b)


FIRST8 = "list_sum(list_transform(range(0, 8), lambda k: CAST(substr(b, {at} + CAST(k AS INTEGER), 1) AS INTEGER) << CAST(7 - k AS INTEGER)))"


@query("bin_values256_float", BINS.format(f"SELECT {FIRST8.format(at=1)} AS bin FROM (SELECT CAST(CAST(abs(CAST(v AS FLOAT)) AS BIT) AS VARCHAR) AS b FROM ({V.CUST}))"))
def _(s, d):
    bits = V.balances(s, d).select(X.float_bits(F.abs(F.col("v").cast("float"))).alias("bits"))
    return histogram.bytes256(bits, 32, 0)


@query("bin_values256_double", BINS.format(f"SELECT {FIRST8.format(at=9)} AS bin FROM (SELECT CAST(CAST(abs(v) AS BIT) AS VARCHAR) AS b FROM ({V.CUST})) WHERE substr(b, 1, 8) = '01000000'"))
def _(s, d):
    bits = V.balances(s, d).select(X.double_bits(F.abs("v")).alias("bits"))
    return histogram.bytes256(bits, 64, 8, 64)


@query("bin_values256_state", BINS.format("SELECT (o_orderkey >> 8) & 255 AS bin FROM orders WHERE o_orderkey >> 16 = 0"))
def _(s, d):
    bits = V.table(s, d, "orders").select(F.col("o_orderkey").alias("bits"))
    return histogram.bytes256(bits, 32, 16, state=s.range(1).select(F.col("id").alias("prefix"), F.lit(7).alias("k")))


@query("bin_values256_done", "SELECT unnest(range(0, 256)) AS bin, CAST(0 AS BIGINT) AS n")
def _(s, d):
    bits = V.table(s, d, "orders").select(F.col("o_orderkey").alias("bits"))
    return histogram.bytes256(bits, 32, 16, state=s.range(1).select(F.col("id").alias("prefix"), F.lit(0).alias("k")))


# Sorting

EVK = V.EV.replace(" AS v ", " AS k ")


def keys(s, d) -> DataFrame:
    return V.events(s, d).withColumnRenamed("v", "k")


@query("sort_batched_desc", f"SELECT i, k, (i // 100) * 100 + row_number() OVER (PARTITION BY i // 100 ORDER BY k DESC, i) - 1 AS pos FROM ({EVK})")
def _(s, d):
    return sorting.batched_descending(keys(s, d), 100).select("i", "k", "pos")


@query("sort_batched_abs", f"SELECT i, k, (i // 100) * 100 + row_number() OVER (PARTITION BY i // 100 ORDER BY abs(k), i) - 1 AS pos FROM ({EVK})")
def _(s, d):
    return sorting.batched_abs(keys(s, d), 100).select("i", "k", "pos")


@query("segmented_sort", f"SELECT seg, i, k, row_number() OVER (PARTITION BY seg ORDER BY k, i) - 1 AS pos FROM ({EVK})")
def _(s, d):
    return sorting.segmented(keys(s, d)).select("seg", "i", "k", "pos")


@query("segmented_sort_pointers", f"SELECT seg, i, k, lo + row_number() OVER (PARTITION BY seg ORDER BY k, i) - 1 AS pos FROM (SELECT i // 100 AS seg, i // 100 * 100 AS lo, i, v AS k FROM ({V.PINT}))")
def _(s, d):
    n = V.table(s, d, "part").count()
    ptrs = s.range(n // 100 + 2).select(F.col("id").alias("line"), F.least(F.col("id") * 100, F.lit(n)).alias("ptr"))
    return sorting.segmented_by_pointers(V.sizes(s, d).withColumnRenamed("v", "k"), ptrs).select("seg", "i", "k", "pos")


@query("abs_order", f"SELECT i, v FROM ({V.CUST})")
def _(s, d):
    return sorting.by_magnitude(V.balances(s, d), descending=True)


# Sparse matrices

A, B = V.matrix_sql(), V.matrix_sql("b")


@query("coo_order_row", f"SELECT row_number() OVER (ORDER BY r, c) - 1 AS pos, r, c, val FROM ({A})")
def _(s, d):
    return coords(V.matrix(s, d).positions(), "pos", "val")


@query("coo_order_col", f"SELECT row_number() OVER (ORDER BY c, r) - 1 AS pos, r, c, val FROM ({A})")
def _(s, d):
    return coords(V.matrix(s, d).with_order("col_major").positions(), "pos", "val")


@query("sort_cols_in_row", f"SELECT r, row_number() OVER (PARTITION BY r ORDER BY c) - 1 AS pos, c FROM ({A})")
def _(s, d):
    return convert.to_rows(V.matrix(s, d)).select(F.col("row").alias("r"), F.posexplode("cols").alias("pos", "c")).withColumn("pos", F.col("pos").cast("long"))


@query("transpose", f"SELECT c AS r, r AS c, val FROM ({A})")
def _(s, d):
    return coords(V.matrix(s, d).transpose().df)


def _pointers_sql(axis: str) -> str:
    return f"SELECT line, CAST(coalesce(sum(n) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM (SELECT g.line, count(m.val) AS n FROM (SELECT unnest(range(0, {V.SIDE} + 1)) AS line) g LEFT JOIN ({A}) m ON g.line = m.{axis} GROUP BY g.line)"


@query("row_ptrs", _pointers_sql("r"))
def _(s, d):
    return sparse.pointers(V.matrix(s, d))


@query("col_ptrs", _pointers_sql("c"))
def _(s, d):
    return sparse.pointers(V.matrix(s, d), "col")


@query("row_ptrs_to_indices", f"SELECT row_number() OVER (ORDER BY r, c) - 1 AS i, r AS line FROM ({A})")
def _(s, d):
    return sparse.pointers_to_indices(sparse.pointers(V.matrix(s, d)))


@query("max_row_nnz", f"SELECT max(n) AS n FROM (SELECT count(*) AS n FROM ({A}) GROUP BY r)")
def _(s, d):
    return sparse.max_row_entries(V.matrix(s, d))


@query("coords_unique", f"SELECT count(*) = count(DISTINCT (r, c)) AS is_unique FROM ({A})")
def _(s, d):
    return sparse.coordinates_unique(V.matrix(s, d))


@query("diagmm", f"SELECT r, c, (r + 1.0) * val AS val FROM ({A})".replace("(r + 1.0)", "CAST(r + 1 AS DOUBLE)"))
def _(s, d):
    diag = G.iota(s, V.side(s, d), 1).select("i", F.col("v").cast("double").alias("v"))
    return coords(sparse.diagmm(diag, V.matrix(s, d)).df)


@query("get_diagonal", f"SELECT g.i, coalesce(m.val, 0.0) AS v FROM (SELECT unnest(range(0, {V.SIDE})) AS i) g LEFT JOIN (SELECT * FROM ({A}) WHERE r = c) m ON g.i = m.r")
def _(s, d):
    return sparse.diagonal(V.matrix(s, d))


@query("fill_diagonal", f"SELECT r, c, CASE WHEN r = c THEN 9.0 ELSE val END AS val FROM ({A})")
def _(s, d):
    return coords(sparse.fill_diagonal(V.matrix(s, d), 9.0).df)


@query("coo_transform", f"SELECT r, c, max(val) AS val FROM (SELECT r, c, 2 * val AS val FROM ({A}) UNION ALL SELECT r, c, -val FROM ({B})) GROUP BY r, c")
def _(s, d):
    return coords(sparse.combine(V.matrix(s, d), V.matrix(s, d, "b"), F.max, lambda v: v * 2, lambda v: -v).df)


@query("coo_transform2", f"SELECT r, c, sum(x) AS val0, sum(y) AS val1 FROM (SELECT r, c, val AS x, abs(val) AS y FROM ({A}) UNION ALL SELECT r, c, 2 * val, val * 0 FROM ({B})) GROUP BY r, c")
def _(s, d):
    return coords(sparse.combine2(V.matrix(s, d), V.matrix(s, d, "b"), F.sum, (lambda v: v, F.abs), (lambda v: v * 2, lambda v: v * 0)), "val0", F.col("val1") + 0.0).withColumnRenamed("(val1 + 0.0)", "val1")


SYM = f"SELECT r, c, sum(x) AS val0, sum(y) AS val1 FROM (SELECT r, c, abs(val) AS x, val AS y FROM ({A}) UNION ALL SELECT c, r, abs(val), 0.0 FROM ({A})) GROUP BY 1, 2"


@query("symmetrize_abs", f"SELECT r, c, val0 AS val FROM ({SYM})")
def _(s, d):
    return coords(sparse.symmetrize_abs(V.matrix(s, d)).df)


@query("make_pattern_symmetric", f"SELECT r, c, val1 + 0.0 AS val FROM ({SYM})")
def _(s, d):
    return coords(sparse.pattern_symmetric(V.matrix(s, d)).df.withColumn("val", F.col("val") + 0.0))


@query("sym_both", f"SELECT r, c, val0, val1 + 0.0 AS val1 FROM ({SYM})")
def _(s, d):
    return coords(sparse.symmetrize_both(V.matrix(s, d)).withColumn("val1", F.col("val1") + 0.0), "val0", "val1")


@query("extend_rows", f"""WITH a AS ({A}), n AS (SELECT g.r, count(a.val) AS k FROM (SELECT unnest(range(0, {V.SIDE})) AS r) g LEFT JOIN a ON a.r = g.r GROUP BY g.r),
near AS (SELECT r, k, unnest(range(0, least(k + 4, {V.SIDE}))) AS c FROM n),
free AS (SELECT r, c, row_number() OVER (PARTITION BY r ORDER BY c) AS p FROM near ANTI JOIN a USING (r, c))
SELECT r, c, val FROM a UNION ALL SELECT r, c, -7.0 FROM free WHERE p <= 4""")
def _(s, d):
    return coords(convert.extend_rows(V.matrix(s, d), 4, -7.0).df)


@query("coo_csr_roundtrip", f"SELECT r, c, val FROM ({A})")
def _(s, d):
    m = V.matrix(s, d)
    return coords(convert.from_rows(convert.to_rows(m), m.num_cols, m.num_rows).df)


@query("csr_arrays", f"SELECT r, row_number() OVER (PARTITION BY r ORDER BY c) - 1 AS pos, c, val FROM ({A})")
def _(s, d):
    rows = csr.RowTable.from_coordinates(V.matrix(s, d)).checked().select(F.col("row").alias("r"), F.posexplode(F.arrays_zip("cols", "vals")).alias("pos", "e"))
    return rows.select("r", F.col("pos").cast("long").alias("pos"), F.col("e.cols").alias("c"), F.col("e.vals").alias("val"))


@query("csr_cast", f"SELECT r, c, CAST(val AS FLOAT) AS val FROM ({A})")
def _(s, d):
    return coords(csr.RowTable.from_coordinates(V.matrix(s, d)).coordinates("float").df)


@query("csr_row", f"SELECT c, val FROM ({A}) WHERE r = 7")
def _(s, d):
    return csr.RowTable.from_coordinates(V.matrix(s, d)).row(7).select(F.col("col").alias("c"), "val")


@query("csr_equal", f"SELECT count(*) = 0 AS equal FROM (({A}) EXCEPT ALL ({A}))")
def _(s, d):
    one, two = (csr.RowTable.from_coordinates(V.matrix(s, d)) for _ in range(2))
    return one.equal(two)


@query("csr_differ", f"SELECT count(*) = 0 AS equal FROM (({A}) EXCEPT ALL ({B}))")
def _(s, d):
    return csr.RowTable.from_coordinates(V.matrix(s, d)).equal(csr.RowTable.from_coordinates(V.matrix(s, d, "b")))


@query("csr_ptrs", _pointers_sql("r"))
def _(s, d):
    return csr.RowTable.from_coordinates(V.matrix(s, d)).pointers()


@query("spans_from_ptrs", f"SELECT r AS src, row_number() OVER (PARTITION BY r ORDER BY c) - 1 AS i, val AS v FROM ({A})")
def _(s, d):
    m = V.matrix(s, d)
    return movement.spans_from_pointers(m.positions().select(F.col("pos").alias("i"), F.col("val").alias("v")), sparse.pointers(m))


@query("matrix_market", f"SELECT r, c, val FROM ({A})")
def _(s, d):
    path = matrix_market.scratch(s)
    matrix_market.write(V.matrix(s, d), path)
    return coords(matrix_market.read(s, path).df)


N = V.NATIONS


@query("dense_export", f"SELECT x.r, y.c, coalesce(m.val, 0.0) AS val FROM (SELECT unnest(range(0, (SELECT count(*) FROM nation))) AS r) x CROSS JOIN (SELECT unnest(range(0, (SELECT count(*) FROM region))) AS c) y LEFT JOIN ({N}) m ON m.r = x.r AND m.c = y.c")
def _(s, d):
    dense = convert.to_dense(V.nations(s, d))
    return dense.select(F.col("row").alias("r"), F.posexplode("vals").alias("c", "val")).select("r", F.col("c").cast("long").alias("c"), "val")


@query("dense_import", f"SELECT r, c, val FROM ({N}) WHERE val <> 0")
def _(s, d):
    m = V.nations(s, d)
    return coords(convert.from_dense(convert.to_dense(m), m.num_cols, m.num_rows).df)


# Permutations and grouping


@query("perm_multiply", f"SELECT a.i, b.i AS p FROM ({PERM_A}) a JOIN ({V.perm_sql(3, 1)}) b ON a.p = b.p")
def _(s, d):
    return permutation.multiply(V.permutation(s, d, 7, 3), V.permutation(s, d, 3, 1))


@query("perm_successive", f"SELECT CAST(0 AS BIGINT) AS j, a.i, b.i AS p FROM ({PERM_A}) a JOIN ({V.perm_sql(3, 1)}) b ON a.p = b.p UNION ALL SELECT 1, a.i, b.i FROM ({V.perm_sql(3, 1)}) a JOIN ({V.perm_sql(11, 5)}) b ON a.p = b.p")
def _(s, d):
    stack = None
    for j, (k, c) in enumerate(((7, 3), (3, 1), (11, 5))):
        p = V.permutation(s, d, k, c).select(F.lit(j).cast("long").alias("j"), "i", "p")
        stack = p if stack is None else stack.unionByName(p)
    return permutation.multiply_successive(stack)


@query("bit_permutation", """WITH f AS (SELECT p_partkey AS i, p_size % 2 = 1 AS s FROM part UNION ALL SELECT count(*), false FROM part)
SELECT i, CASE WHEN s THEN i + 1 ELSE coalesce(max(CASE WHEN NOT s THEN i + 1 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS p FROM f""")
def _(s, d):
    return permutation.swaps(V.sizes(s, d).select("i", (F.col("v") % 2 == 1).alias("f")))


@query("bit_permutation_arrays", """WITH f AS (SELECT p_partkey // 16 AS g, p_partkey % 16 AS j, p_size % 2 = 1 AS s FROM part), n AS (SELECT g, count(*) AS n FROM f GROUP BY g),
e AS (SELECT * FROM f UNION ALL SELECT g, n, false FROM n)
SELECT g, j AS i, CASE WHEN s THEN j + 1 ELSE coalesce(max(CASE WHEN NOT s THEN j + 1 END) OVER (PARTITION BY g ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS p FROM e""")
def _(s, d):
    rows = V.sizes(s, d).select(F.floor(F.col("i") / 16).alias("g"), "i", (F.col("v") % 2 == 1).alias("s"))
    flags = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("f"))
    p = flags.select("g", F.posexplode(permutation.from_swaps(F.transform("f", lambda x: x["s"]))).alias("i", "p"))
    return p.select("g", F.col("i").cast("long").alias("i"), F.col("p").cast("long").alias("p"))


EVENT_PTRS = "SELECT i, CAST(coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM (SELECT g.i, count(e.user_id) AS n FROM (SELECT unnest(range(0, (SELECT max(user_id) + 2 FROM events))) AS i) g LEFT JOIN events e ON e.user_id = g.i GROUP BY g.i)"


@query("wrap_subgroups", f"""WITH p AS ({EVENT_PTRS}), w AS (SELECT i, ptr // 100 AS cur, lag(ptr // 100) OVER (ORDER BY i) AS prev, max(i) OVER () AS last, greatest(max(ptr) OVER () // 100 + 1, 2) - 1 AS n FROM p)
SELECT row_number() OVER (ORDER BY i) - 1 AS "group", i AS ptr FROM w WHERE i = 0 OR i = last OR (cur <> prev AND cur <> 0 AND cur <> n)""")
def _(s, d):
    counts = V.table(s, d, "events").select(F.col("user_id").alias("row"), F.lit(0).alias("col"), F.lit(1).alias("val"))
    top = counts.agg(F.max("row")).first()[0]
    ptrs = sparse.pointers(sparse.SparseTable(counts, top + 1, 1)).select(F.col("line").alias("i"), "ptr")
    return grouping.wrap_subgroups(ptrs, 100)


# Scalars


def numbers(s, d) -> DataFrame:
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderkey") - 700).alias("a"), (F.col("o_custkey") % 41 - 20.5).cast("long").alias("b"))


NUM = "SELECT o_orderkey AS i, o_orderkey - 700 AS a, CAST(trunc(o_custkey % 41 - 20.5) AS BIGINT) AS b FROM orders"


@query("ceil_divide", f"SELECT i, CASE WHEN a = 0 THEN 0 ELSE CAST(sign(a) * sign(b) * ((abs(a) + abs(b) - 1) // abs(b)) AS BIGINT) END AS q FROM ({NUM}) WHERE b <> 0")
def _(s, d):
    return numbers(s, d).filter("b <> 0").select("i", X.ceil_divide(F.col("a"), F.col("b")).alias("q"))


@query("sincos", f"SELECT i, round(sin(a), 9) AS s, round(cos(a), 9) AS c FROM ({NUM})")
def _(s, d):
    both = numbers(s, d).select("i", X.sincos(F.col("a").cast("double")).alias("t"))
    return both.select("i", F.round("t.sin", 9).alias("s"), F.round("t.cos", 9).alias("c"))


@query("clz", f"SELECT i, CAST(CASE WHEN i = 0 THEN 64 ELSE 64 - length(bin(i)) END AS INTEGER) AS z64, CAST(CASE WHEN i = 0 THEN 32 ELSE 32 - length(bin(i)) END AS INTEGER) AS z32 FROM ({NUM})")
def _(s, d):
    return numbers(s, d).select("i", X.count_leading_zeros(F.col("i")).alias("z64"), X.count_leading_zeros(F.col("i"), 32).alias("z32"))


@query("rel_diff", f"SELECT i, round(abs(a - b) / abs(b), 9) AS x FROM ({NUM}) WHERE b <> 0")
def _(s, d):
    n = numbers(s, d).filter("b <> 0")
    return n.select("i", F.round(X.relative_difference(F.col("a").cast("double"), F.col("b").cast("double")), 9).alias("x"))


@query("tuple_to_string", f"SELECT i, CAST(a AS VARCHAR) || ',' || CAST(b AS VARCHAR) || ',' || CAST(a + b AS VARCHAR) AS t FROM ({NUM})")
def _(s, d):
    return numbers(s, d).select("i", X.tuple_to_string(F.col("a").cast("double"), F.col("b").cast("float"), F.col("a") + F.col("b")).alias("t"))


@query("magnitude", f"SELECT i, abs(a) AS m FROM ({NUM})")
def _(s, d):
    return numbers(s, d).select("i", X.magnitude(F.col("a"), "bigint").cast("long").alias("m"))


@query("hostname", "SELECT true AS known")
def _(s, d):
    return s.range(1).select((F.length(F.lit(X.hostname())) > 0).alias("known"))

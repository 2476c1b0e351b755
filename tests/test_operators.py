"""Golden cases and edge cases of the array and matrix operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import scalars as X
from vecloom.functions import tuples as T
from vecloom.operators import convert, csr, elementwise, grouping, histogram, movement, permutation, reduction, selection, sorting, sparse, topk
from vecloom.operators.sparse import SparseTable
from vecloom.plans.running import positions, running
from vecloom.sources import generators as G
from vecloom.sources import matrix_market

MATRICES = [
    ([1, 2, 3, 4], [0, 1, 2, 3], [1, 2, 3, 4], [0, 1, 2, 3, 4, 4, 4, 4], [0, 0, 1, 2, 3, 4, 4, 4], 7, 7),
    ([1], [3], [3], [0, 0, 0, 0, 1, 1], [0, 0, 0, 0, 1, 1, 1], 5, 6),
    ([1, 1, 1], [2, 3, 4], [2, 3, 4], [0, 0, 0, 1, 2, 3], [0, 0, 0, 1, 2, 3, 3], 5, 6),
    ([], [], [], [0], [0], 0, 0),
    ([0], [0], [0], [0, 1], [0, 1], 1, 1),
    ([1, 2, 3, 4], [0, 0, 0, 3], [1, 2, 3, 3], [0, 3, 3, 3, 4], [0, 0, 1, 2, 4], 4, 4),
    ([1, 2, 3, 4], [0, 0, 0, 3], [3, 2, 1, 3], [0, 3, 3, 3, 4], [0, 0, 1, 2, 4], 4, 4),
]


def vector(spark, values, kind="double"):
    values = [float(v) for v in values] if kind in ("double", "float") else values
    return spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")


def listed(df, order="i", col="v"):
    return [r[col] for r in df.orderBy(order).collect()]


def coo(spark, values, rows, cols, n, m, order="none"):
    return SparseTable(spark.createDataFrame([(r, c, float(v)) for r, c, v in zip(rows, cols, values)], "row long, col long, val double"), n, m, order)


def dense(m):
    out = np.zeros((m.num_rows, m.num_cols))
    for r in m.df.collect():
        out[r["row"], r["col"]] += r["val"]
    return out


@pytest.mark.parametrize("case", range(len(MATRICES)))
def test_coordinate_goldens(spark, case):
    values, rows, cols, row_ptrs, col_ptrs, n, m = MATRICES[case]
    a = coo(spark, values, rows, cols, n, m)
    assert listed(sparse.pointers(a), "line", "ptr") == row_ptrs
    assert listed(sparse.pointers(a, "col"), "line", "ptr") == col_ptrs
    assert listed(sparse.diagonal(a)) == [float(x) for x in np.diag(dense(a))]
    assert (dense(convert.from_rows(convert.to_rows(a), m, n)) == dense(a)).all()
    lined = listed(sparse.pointers_to_indices(sparse.pointers(a)), "i", "line")
    assert lined == sorted(rows)
    if n == m:
        d = dense(a)
        assert (dense(sparse.symmetrize_abs(a)) == abs(d) + abs(d.T)).all()
        assert (dense(sparse.pattern_symmetric(a)) == d).all()
        both = {(r["row"], r["col"]): (r["val0"], r["val1"]) for r in sparse.symmetrize_both(a).collect()}
        assert both == {k: ((abs(d) + abs(d.T))[k], d[k]) for k in both} and set(both) == set(zip(rows, cols)) | set(zip(cols, rows))
    else:
        with pytest.raises(ValueError):
            sparse.symmetrize_abs(a)


def test_duplicates_survive_the_round_trip_and_fail_export(spark):
    a = coo(spark, [1, 1, 1], [3, 3, 3], [3, 3, 3], 5, 6)
    assert convert.from_rows(convert.to_rows(a), 6).df.count() == 3
    assert not sparse.coordinates_unique(a).first()[0]
    with pytest.raises(Exception, match="repeated or out of range"):
        convert.to_dense(a).collect()


def test_equality_with_and_without_order(spark):
    a = coo(spark, [1, 2, 3], [0, 0, 1], [1, 2, 0], 4, 4, "row_major")
    b = a.with_order("col_major")
    assert sparse.equal(a, b).first()[0] and not sparse.equal(a, b, ordered=True).first()[0]
    assert sparse.equal(a, a, ordered=True).first()[0]
    assert not sparse.equal(a, coo(spark, [1, 2, 3], [0, 0, 1], [1, 2, 0], 4, 5)).first()[0]
    with pytest.raises(ValueError):
        coo(spark, [], [], [], 2, 2).positions()


@pytest.mark.parametrize(
    "values,cols,ptrs,width,extra,want_cols,want_vals",
    [
        ([1, 2, 3], [4, 5, 6], [0, 1, 3], 7, 1, [[0, 4], [0, 5, 6]], [[0, 1], [0, 2, 3]]),
        ([], [], [0] * 5, 4, 20, [[0, 1, 2, 3]] * 4, [[0] * 4] * 4),
        ([], [], [0] * 5, 4, 2, [[0, 1]] * 4, [[0, 0]] * 4),
        ([7, 8, 9], [1, 2, 3], [0, 0, 3, 3, 3], 4, 2, [[0, 1], [0, 1, 2, 3], [0, 1], [0, 1]], [[0, 0], [0, 7, 8, 9], [0, 0], [0, 0]]),
        ([5], [1], [0, 1], 3, 0, [[1]], [[5]]),
    ],
)
def test_extend_rows_goldens(spark, values, cols, ptrs, width, extra, want_cols, want_vals):
    rows = [r for r in range(len(ptrs) - 1) for _ in range(ptrs[r], ptrs[r + 1])]
    out = convert.to_rows(convert.extend_rows(coo(spark, values, rows, cols, len(ptrs) - 1, width), extra, 0.0)).orderBy("row").collect()
    assert [r["cols"] for r in out] == want_cols and [r["vals"] for r in out] == want_vals


def test_dense_matrices_keep_their_form_when_extended(spark):
    base = [[1, 2, 3, 0, 9], [4, 5, 0, 6, 0], [4, 5, 0, 6, 0], [0, 0, 0, 0, 0]]
    source = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(base)], "row long, vals array<double>")
    m = convert.from_dense(source, 5, 4)
    for extra in (0, 1, 3, 5):
        assert [r["vals"] for r in convert.to_dense(convert.extend_rows(m, extra, 0.0)).orderBy("row").collect()] == base


@pytest.mark.parametrize("kind,n,low,high,k", [("int", 100, 0, 765, 7), ("int", 100, 0, 765, 100), ("int", 100, -(2**31), 2**31 - 1, 13), ("float", 357, -6478, 765, 56), ("int", 100, 0, 125, 7)])
def test_topk_equals_rank(spark, kind, n, low, high, k):
    rng = random.Random(k)
    values = [rng.randint(low, high) for _ in range(n)] + ([low] if kind == "int" else [])
    values = values if kind == "int" else [float(np.float32(v)) for v in values]
    cut = sorted(map(abs, values), reverse=True)[k - 1]
    want = sorted((i, v) for i, v in enumerate(values) if abs(v) >= cut)
    x = vector(spark, values, kind)
    assert sorted((r["i"], r["v"]) for r in topk.k_largest_abs(x, k).collect()) == want
    assert topk.threshold_abs(x, k).first()[0] == cut
    assert topk.k_largest_abs_strict(x, k).count() == k


def test_topk_edges(spark):
    x = vector(spark, [1.0, -1.0, 1.0, 0.0, -0.0, math.nan, math.inf])
    assert sorted(r["i"] for r in topk.k_largest_abs(x, 1).collect()) == [5]
    assert sorted(r["i"] for r in topk.k_largest_abs(x, 3).collect()) == [0, 1, 2, 5, 6]
    assert topk.k_largest_abs(x, 100).count() == 7
    assert topk.k_largest_abs(x.limit(0), 3).count() == 0
    for f in (topk.k_largest_abs, topk.k_largest_abs_strict, topk.threshold_abs):
        with pytest.raises(ValueError):
            f(x, 0)


def test_topk_plan_limits_before_the_shuffle(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    whole = plan(topk.k_largest_abs(vector(spark, [1.0, 2.0]), 1))
    assert "TakeOrderedAndProject" in whole and "Window" not in whole and "Exchange" not in whole.partition("Subquery")[0]
    grouped = plan(topk.k_largest_abs(vector(spark, [1.0, 2.0]).withColumn("g", F.col("i") % 2), 1, "g"))
    assert "WindowGroupLimit" in grouped and "Partial" in grouped


def test_topk_of_groups_with_ties_and_null_keys(spark):
    rows = [("a", i, 5.0 if i < 50 else float(i % 5)) for i in range(100)] + [(None, 200, -2.0), (None, 201, 2.0), (None, 202, 1.0), ("b", 300, math.nan), ("b", 301, 9.0)]
    x = spark.createDataFrame(rows, "g string, i long, v double")
    got = sorted((str(r["g"]), r["i"]) for r in topk.k_largest_abs(x, 1, "g").collect())
    assert got == sorted([("a", i) for i in range(50)] + [("None", 200), ("None", 201), ("b", 300)])


def test_sort_goldens(spark):
    def order(values, size, f):
        x = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, k double")
        return [r["k"] for r in f(x, size).orderBy("pos").collect()]

    assert order([-8.0, 7, 10, -6, 5], 5, sorting.batched_abs) == [5, -6, 7, -8, 10]
    assert order([-8.0, 7, 10, -6, 5, 4], 3, sorting.batched_abs) == [7, -8, 10, 4, 5, -6]
    assert order([1.0, 3, 2, 5, 9, 7], 3, sorting.batched_descending) == [3, 2, 1, 9, 7, 5]
    assert [r["v"] for r in sorting.by_magnitude(vector(spark, [-9.0, 8, 0.5, -3.5, 1.2, -0.6])).collect()] == [0.5, -0.6, 1.2, -3.5, 8, -9]


@pytest.mark.parametrize("ptrs,want", [([0, 5, 10, 15, 20, 25, 30, 35, 40, 45], [0, 2, 4, 6, 9]), ([0, 45], [0, 1]), ([0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 45, 45, 45], [0, 2, 4, 6, 12]), ([0, 45, 45, 45, 45], [0, 4]), ([0], [])])
def test_grouping_goldens(spark, ptrs, want):
    out = grouping.wrap_subgroups(spark.createDataFrame(list(enumerate(ptrs)), "i long, ptr long"), 10)
    assert listed(out, "group", "ptr") == want


@pytest.mark.parametrize("flags", "FFFF FFTF FTTF TFFF FTFFF FFTFFF FFTTTF FFTTTT TTTT TTTF FTTT F T".split())
def test_swap_goldens(spark, flags):
    want = list(range(len(flags) + 1))
    for j, f in enumerate(flags):
        if f == "T":
            want[j], want[j + 1] = want[j + 1], want[j]
    df = spark.createDataFrame([([f == "T" for f in flags],)], "f array<boolean>")
    assert df.select(permutation.from_swaps(F.col("f"))).first()[0] == want


def test_permutation_product(spark):
    a, b = [2, 0, 1, 3], [1, 3, 0, 2]
    pa, pb = (spark.createDataFrame(list(enumerate(p)), "i long, p long") for p in (a, b))
    assert listed(permutation.multiply(pa, pb), "i", "p") == [b.index(x) for x in a]


def test_scalar_goldens(spark):
    cases = [(10, 10, 1), (10, 11, 1), (10, 9, 2), (10, 5, 2), (10, 4, 3), (0, 0, 0), (0, 10, 0), (-10, -10, 1), (-10, -11, 1), (-10, 3, -4), (-10, 5, -2), (-10, -5, 2), (-10, 6, -2)]
    df = spark.createDataFrame(cases, "a long, b long, q long")
    assert df.filter(X.ceil_divide(F.col("a"), F.col("b")) != F.col("q")).count() == 0
    with pytest.raises(Exception, match="division by zero"):
        spark.createDataFrame([(1, 0)], "a long, b long").select(X.ceil_divide(F.col("a"), F.col("b"))).collect()
    z = spark.createDataFrame([(0, 3, 3 * 2**32 + 3, -1)], "a int, b int, c long, d int")
    got = z.select(X.count_leading_zeros(F.col("a"), 32), X.count_leading_zeros(F.col("b"), 32), X.count_leading_zeros(F.col("c")), X.count_leading_zeros(F.col("a")), X.count_leading_zeros(F.col("d"), 32)).first()
    assert list(got) == [32, 30, 30, 64, 0]
    t = spark.sql("SELECT CAST(1 AS FLOAT) a, 2.0D b, 3 c, 1.5D e").select(X.tuple_to_string(*map(F.col, "abc")), X.tuple_to_string(F.col("e")))
    assert list(t.first()) == ["1,2,3", "1.5"]
    assert X.hostname()


def test_float_bits(spark):
    v = [0.0, 1.5, 3.4e38]
    got = [r[0] for r in vector(spark, v, "float").orderBy("i").select(X.float_bits("v")).collect()]
    assert got == np.array(v, np.float32).view(np.uint32).tolist()
    got = [r[0] for r in vector(spark, v).orderBy("i").select(X.double_bits("v")).collect()]
    assert got == np.array(v).view(np.int64).tolist()


def test_tuple_goldens(spark):
    df = spark.createDataFrame([([1.1, 1.2, 1.3],)], "a array<double>")
    a = F.col("a")
    plus = T.with_scalar(a, F.lit(3.0), "+")
    assert df.select(plus).first()[0] == pytest.approx([4.1, 4.2, 4.3])
    assert df.select(T.combine(plus, a, "+")).first()[0] == pytest.approx([5.2, 5.4, 5.6])
    with pytest.raises(ValueError):
        T.with_scalar(a, F.lit(1.0), "-", scalar_first=True)
    with pytest.raises(Exception, match="tuple lengths differ"):
        df.select(T.combine(a, F.array(F.lit(1.0)), "+")).collect()
    s = spark.sql("SELECT named_struct('x', 1, 'y', 2.9D) t")
    kinds = s.schema["t"].dataType
    assert list(s.select(T.assign(lambda v: v * 1.5, kinds, F.col("t")).alias("t")).first()["t"]) == [1, pytest.approx(4.35)]


def test_row_recurrence(spark):
    n = 10
    x = vector(spark, [float(3 * i + 1) for i in range(n)])
    m = {r["i"]: r["v"] for r in x.collect()}
    seven = (m[6] + m[5] * 3.1654) / m[0]
    row = x.agg(*[F.max(F.when(F.col("i") == k, F.col("v"))).alias(f"r{k}") for k in (0, 5, 6)]).select((F.col("r6") + F.col("r5") * 3.1654) / F.col("r0"))
    assert row.first()[0] == pytest.approx(seven)


def test_gather_scatter_find(spark):
    src = vector(spark, [10.0, 20.0, 30.0])
    assert listed(movement.gather(vector(spark, [2, 0, 2, 2], "long"), src)) == [30, 10, 30, 30]
    with pytest.raises(Exception, match="no source element"):
        movement.gather(vector(spark, [5], "long"), src).collect()
    assert listed(movement.gather(vector(spark, [5], "long"), src, strict=False)) == [None]
    dst = vector(spark, [0.0] * 4)
    assert listed(movement.scatter(src, vector(spark, [3, 1, 3], "long"), dst)) == [0, 20, 0, 30]
    assert movement.find(src, 20.0).first()[0] == 1 and movement.find(src, 7.0, 9).first()[0] == 9


@pytest.mark.parametrize("n,block", [(100, 128), (1, 128), (165, 1), (1655, 133)])
def test_block_copy_is_a_copy(spark, n, block):
    x = G.iota(spark, n)
    assert listed(movement.block_copy(x, n, block, block, block, block)) == list(range(n))


def test_block_copy_strided(spark):
    got = {r["i"]: r["v"] for r in movement.block_copy(G.iota(spark, 60), 30, 12, 20, 12, 15, lambda v: -v).collect()}
    assert got == {t // 12 * 15 + t % 12: -(t // 12 * 20 + t % 12) for t in range(30)}


def test_vectors_of_different_length_are_errors(spark):
    with pytest.raises(Exception, match="differ in length"):
        elementwise.axpy(1.0, vector(spark, [1.0]), vector(spark, [1.0, 2.0])).collect()
    assert not elementwise.equal(vector(spark, [1.0]), vector(spark, [1.0, 2.0])).first()[0]
    assert elementwise.equal(vector(spark, []), vector(spark, [])).first()[0]


def test_selection_positions_are_stable(spark):
    x = vector(spark, list(range(1000, 0, -1)), "long").repartition(5)
    got = selection.select_if(x, lambda v: v % 7 == 0).orderBy("pos").collect()
    assert [(r["pos"], r["v"]) for r in got] == list(enumerate(v for v in range(1000, 0, -1) if v % 7 == 0))
    assert selection.select_if(x, lambda v: v < 0).count() == 0


@pytest.mark.parametrize("op,f", [("sum", lambda a, b: a + b), ("min", min), ("max", max), ("product", lambda a, b: a * b)])
def test_running_folds_cross_buckets(spark, op, f):
    values = [random.Random(i).choice([1, 2, -1, 1]) for i in range(60)]
    want = values[:1]
    for v in values[1:]:
        want.append(f(want[-1], v))
    assert listed(reduction.inclusive_scan(vector(spark, values, "long").repartition(3), op, 7)) == want


def test_running_plan_has_no_single_partition_window_over_rows(spark):
    plan = positions(spark.range(100).withColumnRenamed("id", "i"), bucket=10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "_b" in plan
    with pytest.raises(ValueError):
        running(spark.range(1).withColumnRenamed("id", "i"), F.col("i"), "mean", "x")


def test_segment_pointers_with_empty_segments(spark):
    segs = spark.createDataFrame([(0, 0, 3), (1, 3, 3), (2, 3, 10)], "seg long, lo long, hi long")
    got = reduction.segmented_reduce(reduction.by_pointers(vector(spark, [1.0] * 10), segs, 2), segs, "sum", 0.5)
    assert listed(got, "seg") == [3.5, 0.5, 7.5]


def test_histograms(spark):
    x = vector(spark, [0.0, 0.99, 1.0, 9.99, 10.0, -0.1])
    assert listed(histogram.even(x, 10, 0.0, 10.0), "bin", "n") == [2, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    bits = spark.createDataFrame([(0x01020304,), (0x01020405,), (0x02020304,)], "bits long")
    assert {r["bin"]: r["n"] for r in histogram.bytes256(bits, 32, 16, 0x0102).collect() if r["n"]} == {3: 1, 4: 1}
    assert {r["bin"]: r["n"] for r in histogram.bytes256(bits, 32, 0).collect() if r["n"]} == {1: 2, 2: 1}


def test_even_histogram_rounds_in_one_order_and_loses_nothing(spark):
    counts = {r["bin"]: r["n"] for r in histogram.even(vector(spark, [290.0, 290.01, 280.0]), 50, 0.0, 500.0).collect() if r["n"]}
    assert counts == {28: 2, 29: 1}  # 290 / 500 * 50 is just below 29
    assert listed(histogram.even(vector(spark, [-1.0, -5e-324]), 4, -1.0, 0.0), "bin", "n") == [1, 0, 0, 1]
    for low, high in ((0.0, 0.0), (math.nan, 1.0), (-math.inf, 0.0), (-1e308, 1e308)):
        with pytest.raises(ValueError):
            histogram.even(vector(spark, [1.0]), 4, low, high)


def test_generators(spark):
    u = G.uniform_real(spark, 2000, -1.0, 3.0, 4)
    low, high, mean = u.agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert -1 <= low and high < 3 and abs(mean - 1) < 0.2
    assert abs(G.normal_real(spark, 2000, 5.0, 0.5).agg(F.avg("v")).first()[0] - 5) < 0.1
    for bad in (lambda: G.uniform_real(spark, 1, 2.0, 1.0), lambda: G.normal_real(spark, 1, 0.0, -1.0), lambda: G.uniform_complex(spark, 1, 2.0, 1.0), lambda: G.normal_complex(spark, 1, 0.0, -1.0)):
        with pytest.raises(ValueError):
            bad()


def test_matrix_market(spark, tmp_path):
    p = tmp_path / "m.mtx"

    def read(text):
        p.write_text(text)
        m = matrix_market.read(spark, str(p))
        return m.num_rows, m.num_cols, sorted(map(tuple, m.df.collect()))

    head = "%%MatrixMarket matrix "
    assert read(head + "coordinate real symmetric\n% note\n\n3 3 2\n2 1 4.5\n3 3 1\n") == (3, 3, [(0, 1, 4.5), (1, 0, 4.5), (2, 2, 1.0)])
    assert read(head + "coordinate integer skew-symmetric\n3 3 1\n3 1 2\n") == (3, 3, [(0, 2, -2.0), (2, 0, 2.0)])
    assert read(head + "coordinate integer general\n2 3 3\n2 3 3\n1 1 7\n2 3 3\n") == (2, 3, [(0, 0, 7.0), (1, 2, 3.0), (1, 2, 3.0)])
    assert read(head + "coordinate pattern general\n2 2 1\n1 2\n") == (2, 2, [(0, 1, 1.0)])
    assert read(head + "array real general\n2 3\n1\n2\n3\n4\n5\n6\n")[2] == [(0, 0, 1.0), (0, 1, 3.0), (0, 2, 5.0), (1, 0, 2.0), (1, 1, 4.0), (1, 2, 6.0)]
    assert read(head + "array real symmetric\n2 2\n1\n2\n3\n")[2] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 3.0)]
    assert read(head + "array real skew-symmetric\n3 3\n1\n2\n3\n")[2] == [(0, 1, -1.0), (0, 2, -2.0), (1, 0, 1.0), (1, 2, -3.0), (2, 0, 2.0), (2, 1, 3.0)]
    for bad in ("matrix\n", head + "coordinate complex general\n1 1 0\n", head + "coordinate real general\n", head + "coordinate real symmetric\n2 3 0\n", head + "array real general\n2 2\n1\n"):
        with pytest.raises(ValueError):
            read(bad)
    for bad in ("2 2 1\n3 1 1\n", "2 2 1\n1 1\n", "2 2 2\n1 1 1\n", "2 2 1\n0 1 1\n"):
        with pytest.raises(Exception, match="outside the shape"):
            read(head + "coordinate real general\n" + bad)


def test_matrix_market_round_trip(spark):
    m = coo(spark, [0.1, -2.5, 3e300], [0, 1, 4], [2, 0, 3], 5, 4)
    path = matrix_market.scratch(spark)
    matrix_market.write(m, path)
    back = matrix_market.read(spark, path)
    assert (back.num_rows, back.num_cols) == (5, 4) and sorted(map(tuple, back.df.collect())) == sorted(map(tuple, m.df.collect()))


@pytest.mark.parametrize("width,levels", [(3, 4), (256, 4), (2, 1)])
def test_folds_and_scans_with_a_function(spark, width, levels):
    values = [f"{chr(97 + k % 26)}" for k in range(40)]
    x = spark.createDataFrame([(2 * k, v) for k, v in enumerate(values)], "i long, v string").repartition(3)
    first = lambda a, b: F.concat(a, b)  # noqa: E731  associative, does not commute
    assert reduction.tree_fold(x, first, (), width, levels).first()["v"] == "".join(values)
    assert listed(reduction.tree_scan(x, first, width, levels).select("i", "v")) == ["".join(values[: k + 1]) for k in range(40)]
    assert listed(reduction.tree_scan(x, first, width, levels).select("i", F.col("before").alias("v"))) == [None] + ["".join(values[: k + 1]) for k in range(39)]
    assert reduction.reduce(x, first, "<").first()["v"] == "<" + "".join(values)
    assert reduction.reduce(x.limit(0), first, "<").first()["v"] == "<" and reduction.inclusive_scan(x.limit(0), first).count() == 0
    seg = x.withColumn("seg", F.col("i") % 4)
    want = {0: "".join(values[::2]), 2: "".join(values[1::2])}
    segs = spark.createDataFrame([(0,), (1,), (2,)], "seg long")
    got = {r["seg"]: r["v"] for r in reduction.segmented_reduce(seg, segs, first, "-").collect()}
    assert got == {0: "-" + want[0], 1: "-", 2: "-" + want[2]}


def test_views_and_sorts_from_pointers(spark):
    x = vector(spark, [5.0, 4.0, 3.0, 2.0, 1.0])
    ptrs = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (3, 5)], "line long, ptr long")
    assert sorted(map(tuple, movement.spans_from_pointers(x, ptrs).collect())) == [(0, 0, 5.0), (0, 1, 4.0), (2, 0, 3.0), (2, 1, 2.0), (2, 2, 1.0)]
    got = sorting.segmented_by_pointers(x.withColumnRenamed("v", "k"), ptrs).orderBy("pos").collect()
    assert [(r["seg"], r["k"]) for r in got] == [(0, 4.0), (0, 5.0), (2, 1.0), (2, 2.0), (2, 3.0)]


def test_vectors_read_at_offsets(spark):
    x = vector(spark, [1.0, 2.0, 4.0, 8.0])
    got = elementwise.multi({"a": x, "b": x, "c": x}, {"b": -1, "c": 1}).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, 2.0, 1.0, 4.0), (2, 4.0, 2.0, 8.0)]


def test_histogram_with_state(spark):
    bits = spark.createDataFrame([(0x01020304,), (0x01020405,), (0x02020304,)], "bits long")
    state = lambda prefix, k: spark.createDataFrame([(prefix, k)], "prefix long, k long")
    assert {r["bin"]: r["n"] for r in histogram.bytes256(bits, 32, 16, state=state(0x0102, 2)).collect() if r["n"]} == {3: 1, 4: 1}
    for k in (0, -1):
        assert {r["n"] for r in histogram.bytes256(bits, 32, 16, state=state(0x0102, k)).collect()} == {0}


def test_compressed_rows_keep_their_contracts(spark):
    m = csr.RowTable.from_arrays(spark, [1.0, 2.0, 3.0], [4, 5, 6], [0, 1, 1, 3], 7)
    assert sorted(map(tuple, m.coordinates().df.collect())) == [(0, 4, 1.0), (2, 5, 2.0), (2, 6, 3.0)]
    assert sorted(map(tuple, m.row(2).collect())) == [(5, 2.0), (6, 3.0)] and m.row(1).count() == 0
    assert listed(m.pointers(), "line", "ptr") == [0, 1, 1, 3]
    assert m.equal(csr.RowTable.from_coordinates(m.coordinates())).first()[0] and m.coordinates("int").df.schema["val"].dataType.simpleString() == "int"
    assert not m.equal(csr.RowTable.from_arrays(spark, [1.0, 2.0, 9.0], [4, 5, 6], [0, 1, 1, 3], 7)).first()[0]
    assert not m.equal(csr.RowTable.from_arrays(spark, [1.0, 2.0, 3.0], [4, 5, 6], [0, 1, 1, 3], 8)).first()[0]
    assert csr.RowTable.from_arrays(spark, [], [], [0], 3).coordinates().df.count() == 0
    for ptrs in ([], [1, 3], [0, 2], [0, 4, 3], [0, 3, 2, 3]):
        with pytest.raises(ValueError):
            csr.RowTable.from_arrays(spark, [1.0, 2.0, 3.0], [4, 5, 6], ptrs, 7)
    for cols in ([5, 4], [0, 7], [-1, 0]):
        with pytest.raises(Exception, match="bad compressed row"):
            csr.RowTable.from_arrays(spark, [1.0, 2.0], cols, [0, 2], 7).checked().collect()
    with pytest.raises(ValueError):
        m.row(3)


@pytest.mark.parametrize("bucket", [2, 1 << 20])
@pytest.mark.parametrize("flags", "FFFF FFTF FTTF FTFFF FFTTTF TTTT FTTT F T".split())
def test_swaps_of_a_long_vector(spark, flags, bucket):
    want = list(range(len(flags) + 1))
    for j, f in enumerate(flags):
        if f == "T":
            want[j], want[j + 1] = want[j + 1], want[j]
    df = spark.createDataFrame([(j, f == "T") for j, f in enumerate(flags)], "i long, f boolean")
    assert listed(permutation.swaps(df, bucket), "i", "p") == want


def test_grouping_in_small_buckets_and_at_once(spark):
    rng = random.Random(3)
    ptrs = [0]
    for _ in range(200):
        ptrs.append(ptrs[-1] + rng.choice([0, 1, 3, 12, 40]))
    df = spark.createDataFrame(list(enumerate(ptrs)), "i long, ptr long")
    assert listed(grouping.wrap_subgroups(df, 10, bucket=7), "group", "ptr") == listed(grouping.wrap_subgroups(df, 10), "group", "ptr")

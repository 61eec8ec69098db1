import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ResourceLimit, TypeMismatch
from tessera.operators import grouping, quantified, recursion, setops, versions, windows


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("members", [[], [1, 2, 3], [2], [1, None, 3], [None, None]])
@pytest.mark.parametrize("op", quantified.OPERATORS)
def test_quantifiers_follow_three_valued_logic(spark, op, members):
    compare = {"=": int.__eq__, "<>": int.__ne__, "<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}[op]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([None, 0, 1, 2, 4])], "id int, x int")
    rows = spark.createDataFrame([(m,) for m in members], "y int")
    got = quantified.quantified(quantified.quantified(df, "x", op, rows, False, "some"), "x", op, rows, True, "every")
    for r in got.collect():
        each = [None if r.x is None or m is None else compare(r.x, m) for m in members]
        assert r.some == (True if True in each else None if None in each else False)
        assert r.every == (False if False in each else None if None in each else True)


def test_fixpoint_limits_and_null_cycles(spark):
    seed = spark.createDataFrame([(1,)], "n int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, None)], "a int, b int")
    step = lambda t: t.join(edges, t["n"] == edges["a"]).select("b")
    assert values(recursion.fixpoint(seed, step), "n") == sorted([(1,), (2,), (3,), (None,)], key=repr)
    with pytest.raises(ResourceLimit):
        recursion.fixpoint(seed, lambda t: t.select(F.col("n") + 1), max_rounds=3)
    with pytest.raises(ResourceLimit):
        recursion.fixpoint(seed, lambda t: t.crossJoin(spark.range(100)).select(F.col("n")), distinct=False, max_rows=50)


def test_groups_frame_with_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 1, 2), ("a", 1, 3), ("a", 5, 4), ("b", 2, 5)], "p string, k int, v int")
    got = windows.groups_frame(df, ["p"], [F.col("k").asc_nulls_last()], -1, 0, {"s": lambda w: F.sum("v").over(w)})
    assert values(got, "v", "s") == [(1, 5), (2, 5), (3, 5), (4, 9), (5, 5)]


def test_distinct_over_ignores_nulls_and_signs_of_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, None), (4, 2.0)], "i int, x double")
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    got = df.select("i", windows.sum_distinct_over(F.col("x"), w, "double").alias("s"), windows.avg_distinct_over(F.col("x"), w).alias("a"))
    assert values(got, "i", "s", "a") == [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 2.0, 1.0)]


def test_empty_grouping_sets(spark):
    none = spark.createDataFrame([], "a int, b int")
    assert values(grouping.grouping_sets(none, grouping.rollup_sets(["a", "b"]), [F.count("b").alias("n")], bits=["a", "b"]), "a", "b", "grouping_bits", "n") == [(None, None, 3, 0)]
    assert grouping.cube_sets(["a", "b"]) == [["a", "b"], ["a"], ["b"], []]


def test_common_types():
    i, b, d, s = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()
    assert setops.common_type(i, b) == b and setops.common_type(b, d) == d and setops.common_type(s, s) == s
    assert setops.common_type(T.DecimalType(10, 2), T.DecimalType(12, 4)) == T.DecimalType(12, 4)
    assert setops.common_type(i, T.FloatType()) == T.FloatType() and setops.common_type(T.NullType(), s) == s
    for a, c in ((i, s), (s, T.BooleanType()), (T.DateType(), i)):
        with pytest.raises(TypeMismatch):
            setops.common_type(a, c)


def test_union_by_name_refusals(spark):
    a, b = spark.range(2).toDF("x"), spark.range(2).toDF("y")
    with pytest.raises(TypeMismatch):
        setops.union_by_name(a, b)
    assert setops.union_by_name(a, a.withColumnRenamed("x", "X"), all=True).columns == ["x"]


def test_versions(spark):
    log = spark.createDataFrame([("a", 1, "put", "x"), ("a", 5, "delete", None), ("b", 2, "put", "y"), ("b", 6, "put", "z"), ("c", 7, "put", "w")], "key string, seq long, op string, value string")
    assert values(versions.as_of(log, 4), "key", "value") == [("a", "x"), ("b", "y")]
    assert values(versions.as_of(log, 9), "key", "value") == [("b", "z"), ("c", "w")]
    assert [(r.key, r.truncated) for r in versions.range_scan(log, 9, "a", None, limit=1).collect()] == [("b", True)]
    assert values(versions.compact(log, []), "key", "seq") == [("b", 6), ("c", 7)]
    assert values(versions.compact(log, [4]), "key", "seq") == [("a", 1), ("a", 5), ("b", 2), ("b", 6), ("c", 7)]

"""Queries that need the operator library: what Spark SQL cannot say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.profile import profile
from tessera.operators import counting, grouping, quantified, recursion, setops, versions, windows
from tessera.plans.catalogue import register, table
from tessera.plans.text import run
from tessera.session import configure


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(configure(spark), d, "part")


# Windows
def _w1_unordered(spark: SparkSession, d: str) -> DataFrame:
    numbered = _part(spark, d).select("p_brand", windows.bigint_rank(F.row_number().over(windows.unordered("p_brand"))).alias("rn"))
    return numbered.groupBy("p_brand").agg(F.min("rn").alias("lo"), F.max("rn").alias("hi"), F.count_distinct("rn").alias("n"))


register("w1_row_number_without_order", _w1_unordered, "SELECT p_brand, min(rn) AS lo, max(rn) AS hi, count(DISTINCT rn) AS n FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand) AS rn FROM part) GROUP BY p_brand")

_NULLABLE = "CASE WHEN p_size > 40 THEN NULL ELSE p_size END"


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).withColumn("k", F.expr(_NULLABLE))


def _w16(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("k").desc_nulls_first()]
    made = {"n": lambda w: F.count("k").over(w), "s": lambda w: F.sum("p_size").over(w)}
    return windows.groups_frame(_sized(spark, d), ["p_brand"], order, -1, 2, made).select("p_partkey", "n", "s")


register("w16_groups_frame", _w16, f"""
SELECT p_partkey, count(k) OVER w AS n, CAST(sum(p_size) OVER w AS BIGINT) AS s FROM (SELECT *, {_NULLABLE} AS k FROM part)
WINDOW w AS (PARTITION BY p_brand ORDER BY k DESC NULLS FIRST GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING)""")


def _w12(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(-5, 1)
    k = F.col("k")
    return _sized(spark, d).select("p_partkey", windows.count_distinct_over(k, w).alias("n"), windows.sum_distinct_over(k, w).alias("s"), windows.avg_distinct_over(k, w).alias("a"))


register("w12_distinct_over", _w12, f"""
SELECT p_partkey, count(DISTINCT k) OVER w AS n, CAST(sum(DISTINCT k) OVER w AS BIGINT) AS s, avg(DISTINCT k) OVER w AS a FROM (SELECT *, {_NULLABLE} AS k FROM part)
WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING)""")


def _w13(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    big = F.col("p_size") > 25
    return _part(spark, d).select("p_partkey", F.sum(windows.filtered(F.col("p_size"), big)).over(w).alias("s"), F.count(windows.filtered(F.lit(1), big)).over(w).alias("n"))


register("w13_filter_over", _w13, "SELECT p_partkey, CAST(sum(p_size) FILTER (WHERE p_size > 25) OVER w AS BIGINT) AS s, count(*) FILTER (WHERE p_size > 25) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")


def _w19(spark: SparkSession, d: str) -> DataFrame:
    base = Window.partitionBy("p_brand")
    by_size = base.orderBy(F.col("p_size").asc_nulls_last(), "p_partkey")
    return _part(spark, d).select("p_partkey", F.count(F.lit(1)).over(base).alias("whole"), windows.bigint_rank(F.row_number().over(by_size)).alias("rn"), F.sum("p_size").over(by_size.rowsBetween(-1, 0)).alias("s"))


register("w19_extended_named_window", _w19, "SELECT p_partkey, count(*) OVER w AS whole, row_number() OVER o AS rn, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size ASC NULLS LAST, p_partkey ROWS 1 PRECEDING) AS BIGINT) AS s FROM part WINDOW w AS (PARTITION BY p_brand), o AS (PARTITION BY p_brand ORDER BY p_size ASC NULLS LAST, p_partkey)")


def _w21(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc_nulls_first(), "o_orderkey")
    top = windows.qualify(table(configure(spark), d, "orders"), {"rn": F.row_number().over(w)}, F.col("rn") <= 2)
    return top.select("o_custkey", "o_orderkey", "o_totalprice")


register("w21_qualify", _w21, "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) <= 2")


# Grouping
def _sets(sets):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return grouping.grouping_sets(table(configure(spark), d, "orders"), sets, [F.count(F.lit(1)).alias("n")], bits=["o_orderstatus", "o_orderpriority"])

    return query


_GROUPED = "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS INT) AS grouping_bits, count(*) AS n FROM orders GROUP BY "
_KEYS = ["o_orderstatus", "o_orderpriority"]
register("a14_grouping_sets_duplicates", _sets([["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus"], []]), _GROUPED + "GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus), ())")
register("a14_rollup", _sets(grouping.rollup_sets(_KEYS)), _GROUPED + "ROLLUP (o_orderstatus, o_orderpriority)")
register("a17_grouping_bit_string", _sets(grouping.cube_sets(_KEYS)), _GROUPED + "CUBE (o_orderstatus, o_orderpriority)")


def _a15(spark: SparkSession, d: str) -> DataFrame:
    none = table(configure(spark), d, "part").filter("p_partkey < 0")
    return grouping.grouping_sets(none, [["p_brand"], []], [F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("s")])


register("a15_empty_set_over_empty_input", _a15, "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s FROM part WHERE p_partkey < 0 GROUP BY ROLLUP (p_brand)")
register("a16_group_by_nothing", lambda spark, d: grouping.grouping_sets(_part(spark, d), [[]], [F.count(F.lit(1)).alias("n"), F.max("p_size").alias("m")]), "SELECT count(*) AS n, max(p_size) AS m FROM part GROUP BY ()")
register("a13_group_by_all", lambda spark, d: grouping.group_by_all(_part(spark, d), {"p_brand": F.col("p_brand")}, {"one": F.lit(1)}, [F.count(F.lit(1)).alias("n")]), "SELECT p_brand, 1 AS one, count(*) AS n FROM part GROUP BY p_brand")
register("a13_group_by_all_constants_only", lambda spark, d: grouping.group_by_all(_part(spark, d).filter("p_partkey < 0"), {}, {"one": F.lit(1)}, [F.count(F.lit(1)).alias("n")]), "SELECT 1 AS one, count(*) AS n FROM part WHERE p_partkey < 0")

# Joins
def _j4(spark: SparkSession, d: str) -> DataFrame:
    # Suppliers and customers of a nation are counted and multiplied: their pairs grow with the square of the tables.
    region, nation, supplier, customer = (table(configure(spark), d, t) for t in ("region", "nation", "supplier", "customer"))
    sides = counting.join_weighed(counting.weighed(supplier, "s_nationkey"), counting.weighed(customer, "c_nationkey"), ("s_nationkey", "c_nationkey"), "s_nationkey")
    nations = counting.join_weighed(counting.weighed(nation, "n_nationkey", "n_regionkey"), sides, ("n_nationkey", "s_nationkey"), "n_regionkey")
    return counting.join_weighed(counting.weighed(region, "r_regionkey", "r_name"), nations, ("r_regionkey", "n_regionkey"), "r_name")


register("j4_multi_self", _j4, "SELECT r.r_name, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY r.r_name")


# Quantified comparisons as values: a plain set, one with NULLs, an empty one
_MEMBERS = {
    "plain": "SELECT n_nationkey AS y FROM {nation} WHERE n_nationkey BETWEEN 5 AND 12",
    "nulls": "SELECT CASE WHEN n_nationkey > 8 THEN NULL ELSE n_nationkey END AS y FROM {nation} WHERE n_nationkey BETWEEN 5 AND 12",
    "empty": "SELECT n_nationkey AS y FROM {nation} WHERE n_nationkey < 0",
}
_NAMES = {"=": "eq", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


def _quantifiers(members: str, every: bool):
    def query(spark: SparkSession, d: str) -> DataFrame:
        out, rows = _sized(spark, d).select("p_partkey", "k"), run(spark, d, members)
        for op, name in _NAMES.items():
            out = quantified.quantified(out, "k", op, rows, every, name)
        return out.drop("k")

    return query


for _set, _sql in _MEMBERS.items():
    for _every, _word in ((False, "ANY"), (True, "ALL")):
        _inner = _sql.replace("{nation}", "nation")
        _columns = ", ".join(f"k {op} {_word} ({_inner}) AS {name}" for op, name in _NAMES.items())
        register(f"q5_{_word.lower()}_{_set}", _quantifiers(_sql, _every), f"SELECT p_partkey, {_columns} FROM (SELECT *, {_NULLABLE} AS k FROM part)")


def _q4(spark: SparkSession, d: str) -> DataFrame:
    out, rows = _sized(spark, d).select("p_partkey", "k"), run(spark, d, _MEMBERS["nulls"])
    return quantified.in_value(quantified.in_value(out, "k", rows, "i"), "k", rows, "n", negated=True).drop("k")


register("q4_in_as_value", _q4, f"SELECT p_partkey, k IN ({_MEMBERS['nulls']}) AS i, k NOT IN ({_MEMBERS['nulls']}) AS n FROM (SELECT *, {_NULLABLE} AS k FROM part)".replace("{nation}", "nation"))


def _q5_correlated(spark: SparkSession, d: str) -> DataFrame:
    members = run(spark, d, "SELECT CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey AS INT) END AS y, s_nationkey FROM {supplier}")
    return quantified.quantified(run(spark, d, "SELECT n_nationkey, n_regionkey AS x FROM {nation}"), "x", "<", members, True, "v", on=("n_nationkey", "s_nationkey")).select("n_nationkey", "v")


register("q5_all_correlated", _q5_correlated, "SELECT n_nationkey, n_regionkey < ALL (SELECT CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey AS INT) END FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS v FROM nation n")


def _q8(spark: SparkSession, d: str) -> DataFrame:
    # The aggregate stays a plain correlated scalar; the outer column joins it outside.
    return run(spark, d, "SELECT c_custkey, CASE WHEN n = 0 THEN c_custkey ELSE n END AS v FROM (SELECT c.c_custkey, (SELECT COUNT(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) AS n FROM {customer} c) t")


register("q8_outer_column_beside_aggregate", _q8, "SELECT c_custkey, (SELECT CASE WHEN count(*) = 0 THEN c.c_custkey ELSE count(*) END FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) AS v FROM customer c")


def _q9(spark: SparkSession, d: str) -> DataFrame:
    # The middle level becomes a join, so that only one level is crossed.
    return run(spark, d, "SELECT r_regionkey FROM {region} r WHERE r.r_regionkey IN (SELECT n.n_regionkey FROM {nation} n JOIN {supplier} s ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey > r.r_regionkey)")


register("q9_skip_level_correlation", _q9, "SELECT r_regionkey FROM region r WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey > r.r_regionkey))")


# Recursion with UNION
def _c4(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    seed = run(spark, d, "SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey = 1")
    return recursion.fixpoint(seed, lambda t: t.select(((F.col("k") * 3 + 1) % 25).alias("k")), linear=True)


register("c4_recursive_union_cycle", _c4, "WITH RECURSIVE t(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT (k * 3 + 1) % 25 FROM t) SELECT k FROM t")


def _c4_graph(spark: SparkSession, d: str) -> DataFrame:
    edges = run(spark, d, "SELECT DISTINCT n_nationkey AS a, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE (n_nationkey * 5 + n_regionkey) % 25 END AS b FROM {nation}")
    seed = run(spark, d, "SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey IN (2, 9)")
    return recursion.fixpoint(seed, lambda t: t.join(edges, t["k"] == edges["a"]).select(edges["b"].alias("k")))


register("c4_recursive_union_graph_with_nulls", _c4_graph, "WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE (n_nationkey * 5 + n_regionkey) % 25 END AS b FROM nation), t(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey IN (2, 9) UNION SELECT e.b FROM t JOIN e ON t.k = e.a) SELECT k FROM t")


# Set operations
def _u7(all: bool):
    def query(spark: SparkSession, d: str) -> DataFrame:
        left = run(spark, d, "SELECT c_nationkey AS nation, c_mktsegment AS segment FROM {customer}")
        right = run(spark, d, "SELECT CAST(s_suppkey AS BIGINT) AS supp, CAST(s_nationkey AS BIGINT) AS nation FROM {supplier}")
        return setops.union_by_name(left, right, all)

    return query


_U7 = "SELECT CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment FROM customer UNION {} BY NAME SELECT CAST(s_suppkey AS BIGINT) AS supp, CAST(s_nationkey AS BIGINT) AS nation FROM supplier"
register("u7_union_by_name", _u7(False), _U7.format(""))
register("u7_union_all_by_name", _u7(True), _U7.format("ALL"))
register("u9_widening", lambda spark, d: setops.union(run(spark, d, "SELECT n_nationkey AS k FROM {nation}"), run(spark, d, "SELECT s_suppkey FROM {supplier}"), all=True), "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT s_suppkey FROM supplier")
register("u10_order_by_output", lambda spark, d: setops.except_(run(spark, d, "SELECT p_size AS k FROM {part}"), run(spark, d, "SELECT n_nationkey FROM {nation}")).orderBy(F.col("k").desc_nulls_first()), "SELECT DISTINCT p_size AS k FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation) ORDER BY k DESC")


# Versions: the events as a log of puts and deletes, keyed by user
def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(configure(spark), d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "delete").otherwise("put").alias("op"), "value")


_LOG = "(SELECT user_id AS key, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'delete' ELSE 'put' END AS op, value FROM events)"
def _at(log: DataFrame, tenths: int):
    """An as-of point so many tenths into the log, whatever its size."""
    return log.agg(F.expr(f"max(seq) * {tenths} div 10")).scalar()


_AT = f"(SELECT max(seq) * {{}} // 10 FROM {_LOG})"
_NEWEST = f"SELECT key, seq, op, value FROM {_LOG} WHERE seq <= {{}} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"
register("k1_read_as_of", lambda spark, d: versions.as_of(_log(spark, d), _at(_log(spark, d), 7)), f"SELECT * FROM ({_NEWEST.format(_AT.format(7))}) WHERE op <> 'delete'")
register("k2_range_scan", lambda spark, d: versions.range_scan(_log(spark, d), _at(_log(spark, d), 9), 10, 60), f"SELECT * FROM ({_NEWEST.format(_AT.format(9))}) WHERE op <> 'delete' AND key >= 10 AND key < 60")
register("s12_range_with_limit", lambda spark, d: versions.range_scan(_log(spark, d), _at(_log(spark, d), 9), 5, None, limit=20), f"SELECT *, count(*) OVER () > 20 AS truncated FROM ({_NEWEST.format(_AT.format(9))}) WHERE op <> 'delete' AND key >= 5 ORDER BY key LIMIT 20")
register("k3_compaction", lambda spark, d: versions.compact(_log(spark, d), [300, 600]), f"""
SELECT key, seq, op, value FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS f FROM (
    SELECT * FROM {_LOG} QUALIFY row_number() OVER (PARTITION BY key, CASE WHEN seq <= 300 THEN 0 WHEN seq <= 600 THEN 1 ELSE 2 END ORDER BY seq DESC) = 1))
WHERE NOT (f = 1 AND op = 'delete')""")


def _s6(spark: SparkSession, d: str) -> DataFrame:
    base = run(spark, d, "SELECT n_nationkey, n_name, n_regionkey FROM {nation}")
    puts = base.filter("n_nationkey < 5").withColumn("n_name", F.upper(F.concat("n_name", F.lit("*"))))
    return versions.overlay(base, puts, base.filter("n_nationkey IN (7, 9)"), ["n_nationkey"])


register("s6_read_your_writes", _s6, "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN upper(n_name || '*') ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (7, 9)")


# The profile of a result
def _k7(spark: SparkSession, d: str) -> DataFrame:
    return profile(run(spark, d, "SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS some FROM {nation}"))


_K7 = "SELECT {} AS position, '{}' AS column, count(*) AS rows, count(*) - count({}) AS nulls, count(DISTINCT {}) AS distinct, CAST(min({}) AS VARCHAR) AS least, CAST(max({}) AS VARCHAR) AS greatest FROM (SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS some FROM nation)"
register("k7_result_profile", _k7, " UNION ALL ".join(_K7.format(i, c, *[f'"{c}"'] * 4).replace(" AS column,", ' AS "column",').replace(" AS distinct,", ' AS "distinct",').replace(" AS rows,", ' AS "rows",') for i, c in enumerate(("n_nationkey", "n_name", "some"))))

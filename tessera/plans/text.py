"""Queries whose SQL both Spark and DuckDB run: {table} names one of the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.dialect.rewrite import ordered_limits
from tessera.plans.catalogue import register, table
from tessera.session import configure


def run(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Run SQL over the driver's tables, each read with only the columns and rows the plan needs."""
    names = set(re.findall(r"{(\w+)}", text))
    return configure(spark).sql(ordered_limits(text), **{n: table(spark, d, n) for n in names})


def plain(text: str) -> str:
    """The same SQL for DuckDB."""
    return re.sub(r"{(\w+)}", r"\1", text)


def both(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query by its SQL; oracle: DuckDB's spelling where it differs."""
    register(name, lambda spark, d, t=text: run(spark, d, t), plain(oracle or text))


# Scans, projection, predicates, scalar functions
both("s1_seq_scan_filter", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity > 45 AND l_returnflag = 'R'")
both("s2_pk_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderkey = 77")
both("s3_pk_range", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey BETWEEN 100 AND 400")
both("s4_index_equality_range", "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND c_acctbal < 5000")
both("s7_empty_relation", "SELECT 1 AS one, 'x' AS name, CAST(NULL AS INT) AS nothing")
both("s8_derived_table", "SELECT s.c_nationkey, s.n FROM (SELECT c_nationkey, COUNT(*) AS n FROM {customer} GROUP BY c_nationkey) s WHERE s.n > 3")
both("s9_cte_read_twice", "WITH c AS (SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM c a JOIN (SELECT MAX(n) AS top FROM c) m ON a.n = m.top")
both("s11_values", "SELECT k, v FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS t(k, v)")
both("p1_projection_aliases", "SELECT o.o_orderkey AS k, o.*, o.o_totalprice * 2 AS twice FROM {orders} o")
both("p3_three_valued", """
SELECT d.doc_id, q IS NULL AS unknown, q = 1 AND t = 0 AS both_true, q = 1 OR t = 0 AS one_true, NOT (q = 1) AS negated
FROM {documents} d LEFT JOIN (SELECT doc_id, quality AS q, toxic AS t FROM {labels}) l ON d.doc_id = l.doc_id""")
both("p3_filter_keeps_true_only", "SELECT d.doc_id FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 0)")
both("p5_comparisons", "SELECT p_partkey, p_size < 10 AS lt, p_size <= 10 AS le, p_size = 10 AS eq, p_size <> 10 AS ne, p_size > 10 AS gt, p_size >= 10 AS ge FROM {part}")
both("p6_is_null", "SELECT COUNT(*) AS n FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL AND d.text IS NOT NULL")
both("p7_between_unknown_bound", "SELECT p_partkey, p_size BETWEEN 5 AND CASE WHEN p_size > 20 THEN NULL ELSE 15 END AS b, p_size NOT BETWEEN 5 AND CASE WHEN p_size > 20 THEN NULL ELSE 15 END AS nb FROM {part}")
both("p8_in_list_with_null", "SELECT p_partkey, p_size IN (1, 2, NULL) AS i, p_size NOT IN (1, 2, NULL) AS n FROM {part}")
both("p9_like", r"SELECT p_partkey, p_name LIKE '%a_e%' ESCAPE '~' AS l, p_name NOT LIKE 'A%' ESCAPE '~' AS nl, p_type ILIKE '%ECO%' ESCAPE '~' AS il FROM {part}")
both("p10_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS size_class, CASE p_size WHEN 1 THEN 'one' WHEN NULL THEN 'never' ELSE 'other' END AS simple FROM {part}")
both("f_length_upper_lower", "SELECT doc_id, CAST(LENGTH(text) AS INT) AS n, UPPER(lang) AS u, LOWER(source) AS l FROM {documents}")
both("f_arithmetic", "SELECT p_partkey, p_size + 1 AS a, p_size - 100 AS s, p_size * 3 AS m, CAST(p_size div 7 AS INT) AS d, p_size % 7 AS r, -p_size AS neg, ABS(p_size - 25) AS ab, CAST((p_size - 25) div 4 AS INT) AS trunc, (p_size - 25) % 4 AS rem FROM {part}",
     "SELECT p_partkey, p_size + 1 AS a, p_size - 100 AS s, p_size * 3 AS m, p_size // 7 AS d, p_size % 7 AS r, -p_size AS neg, ABS(p_size - 25) AS ab, CAST(trunc((p_size - 25) / 4) AS INT) AS trunc, (p_size - 25) % 4 AS rem FROM part")
both("f_temporal_literals", "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' AND CAST(o_orderdate AS DATE) < DATE '1997-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND CAST(o_orderdate AS DATE) < DATE '1997-01-01'")

# Joins
both("j1_inner_equi", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey")
both("j1_inner_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("j2_left_outer", "SELECT d.doc_id, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id AND l.quality = 1")
both("j3_key_join", "SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, p.p_brand FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey")
both("j5_lateral", "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM {customer} c JOIN LATERAL (SELECT o.o_orderkey, o.o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 2) t ON TRUE")
both("j5_left_lateral", "SELECT c.c_custkey, t.top FROM {customer} c LEFT JOIN LATERAL (SELECT MAX(o.o_totalprice) AS top FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) t ON t.top IS NOT NULL")
both("j7_semi", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
both("j7_anti", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")

# Aggregation
both("a1_counts_sums", """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(l_tax) AS n_tax, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_discount), 6) AS d,
MIN(l_shipdate) AS first_day, MAX(l_extendedprice) AS top FROM {lineitem} GROUP BY l_returnflag, l_linestatus""")
both("a3_count_several", "SELECT d.lang, COUNT(l.quality, l.toxic) AS n FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.lang", "SELECT d.lang, COUNT(*) FILTER (WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
both("a4_sum_types", "SELECT SUM(p_size) AS i, SUM(p_partkey) AS b, CAST(SUM(CAST(p_size AS FLOAT)) AS FLOAT) AS r, SUM(CAST(p_size AS DECIMAL(10,2))) AS dec, SUM(CASE WHEN p_size < 0 THEN p_size END) AS none FROM {part}", "SELECT CAST(SUM(p_size) AS BIGINT) AS i, CAST(SUM(p_partkey) AS BIGINT) AS b, CAST(SUM(CAST(p_size AS FLOAT)) AS FLOAT) AS r, CAST(SUM(CAST(p_size AS DECIMAL(10,2))) AS DECIMAL(20,2)) AS dec, CAST(SUM(CASE WHEN p_size < 0 THEN p_size END) AS BIGINT) AS none FROM part")
both("a7_distinct_aggregates", "SELECT p_brand, COUNT(DISTINCT p_type) AS types, COUNT(DISTINCT p_size) AS sizes, SUM(DISTINCT p_size) AS s, COUNT(DISTINCT p_type, p_size) AS pairs FROM {part} GROUP BY p_brand", "SELECT p_brand, COUNT(DISTINCT p_type) AS types, COUNT(DISTINCT p_size) AS sizes, CAST(SUM(DISTINCT p_size) AS BIGINT) AS s, COUNT(DISTINCT (p_type, p_size)) AS pairs FROM part GROUP BY p_brand")
both("a8_filter", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, ROUND(SUM(o_totalprice) FILTER (WHERE o_totalprice > 200000), 2) AS s FROM {orders} GROUP BY o_orderpriority")
both("a9_group_by_expression_nulls", "SELECT CASE WHEN p_size > 25 THEN NULL ELSE p_size % 3 END AS k, COUNT(*) AS n FROM {part} GROUP BY CASE WHEN p_size > 25 THEN NULL ELSE p_size % 3 END")
both("a11_global_over_empty", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS m FROM {orders} WHERE o_orderkey < 0")
both("a12_having", "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 15")
both("a12_having_without_group", "SELECT COUNT(*) AS n FROM {orders} HAVING COUNT(*) > 10")
both("a14_cube_rollup_mixed", "SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus) * 2 + GROUPING(o_orderpriority) AS g, COUNT(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus, o_orderpriority) AS INT) AS g, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("a14_composite_sets", "SELECT p_brand, p_size, COUNT(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand, p_size), (p_brand), (p_brand))")
both("a18_omitted_keys_read_null", "SELECT COALESCE(o_orderstatus, 'all') AS s, COUNT(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus)")

# Windows
W = "PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST"
both("w1_ranks", f"SELECT o_orderkey, CAST(ROW_NUMBER() OVER ({W}) AS BIGINT) AS rn, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus NULLS LAST) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus NULLS LAST) AS BIGINT) AS dr FROM {{orders}}")
both("w4_percent_cume_ntile", f"SELECT o_orderkey, ROUND(PERCENT_RANK() OVER ({W}), 9) AS pr, ROUND(CUME_DIST() OVER ({W}), 9) AS cd, CAST(NTILE(4) OVER ({W}) AS BIGINT) AS nt FROM {{orders}}")
both("w7_lag_lead", "SELECT conv_id, turn, LAG(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, LEAD(role, 2, 'none') OVER (PARTITION BY conv_id ORDER BY turn) AS next2, LAG(turn, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS same FROM {conversations}")
both("w8_first_last_nth", "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l, NTH_VALUE(o_orderkey, 2) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
both("w10_ignore_nulls", """SELECT doc_id, LAG(q) IGNORE NULLS OVER (PARTITION BY lang ORDER BY doc_id) AS prev, FIRST_VALUE(q) IGNORE NULLS OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f
FROM (SELECT d.doc_id, d.lang, l.quality AS q FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) t""",
     """SELECT doc_id, LAG(q IGNORE NULLS) OVER (PARTITION BY lang ORDER BY doc_id) AS prev, FIRST_VALUE(q IGNORE NULLS) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f
FROM (SELECT d.doc_id, d.lang, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t""")
both("w11_aggregates_over", "SELECT o_orderkey, COUNT(*) OVER w AS n, MIN(o_totalprice) OVER w AS lo, MAX(o_totalprice) OVER w AS hi, AVG(o_orderkey) OVER w AS a FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
both("w14_rows_frame", "SELECT event_id, COUNT(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS n, MAX(value) OVER (PARTITION BY user_id ORDER BY ts ROWS 3 PRECEDING) AS m FROM {events}")
both("w15_range_frame_null_keys", """SELECT p_partkey, SUM(p_size) OVER (PARTITION BY p_brand ORDER BY k ASC NULLS FIRST RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s
FROM (SELECT p_partkey, p_brand, p_size, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS k FROM {part}) t""",
     """SELECT p_partkey, CAST(SUM(p_size) OVER (PARTITION BY p_brand ORDER BY k ASC NULLS FIRST RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s
FROM (SELECT p_partkey, p_brand, p_size, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS k FROM part) t""")
both("w17_default_frames", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand) AS whole, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto FROM {part}")
both("w20_windows_over_aggregates", "SELECT o_custkey, COUNT(*) AS n, CAST(RANK() OVER (PARTITION BY MIN(o_orderpriority) ORDER BY COUNT(*) DESC, o_custkey) AS BIGINT) AS r FROM {orders} GROUP BY o_custkey")

# Subqueries
both("q1_scalar", "SELECT o_orderkey, (SELECT MAX(o_totalprice) FROM {orders}) AS top, (SELECT p_size FROM {part} WHERE p_partkey < 0) AS nothing, o_totalprice > (SELECT AVG(o_totalprice) FROM {orders}) * 1.9D AS dear FROM {orders}", "SELECT o_orderkey, (SELECT MAX(o_totalprice) FROM orders) AS top, (SELECT p_size FROM part WHERE p_partkey < 0) AS nothing, o_totalprice > (SELECT AVG(o_totalprice) FROM orders) * 1.9 AS dear FROM orders")
both("q3_not_in_where_with_null", "SELECT p_partkey FROM {part} WHERE p_size NOT IN (SELECT CASE WHEN n_nationkey > 20 THEN NULL ELSE n_nationkey END FROM {nation})")
both("q3_in_where", "SELECT p_partkey FROM {part} WHERE p_size IN (SELECT CASE WHEN n_nationkey > 20 THEN NULL ELSE n_nationkey END FROM {nation})")
both("q6_correlated_scalar", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS top, (SELECT COUNT(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000) AS n FROM {customer} c")
both("q6_correlated_order_limit", "SELECT c_custkey, (SELECT o.o_orderkey FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 1) AS best FROM {customer} c")
both("q7_correlated_in", "SELECT n_nationkey FROM {nation} n WHERE n.n_nationkey IN (SELECT c.c_nationkey FROM {customer} c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000)")
both("q7_correlated_not_in", "SELECT n_nationkey FROM {nation} n WHERE 5 NOT IN (SELECT c.c_custkey FROM {customer} c WHERE c.c_nationkey = n.n_nationkey)")
both("q10_in_having", "SELECT o_orderstatus, COUNT(*) AS n FROM {orders} GROUP BY o_orderstatus HAVING COUNT(*) > (SELECT COUNT(*) FROM {customer}) / 100D", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus HAVING COUNT(*) > (SELECT COUNT(*) FROM customer) / 100.0")

# CTEs and recursion
both("c1_chained_and_shadowing", "WITH orders AS (SELECT o_custkey AS k, o_totalprice AS p FROM {orders}), big AS (SELECT k, COUNT(*) AS n FROM orders WHERE p > 200000 GROUP BY k) SELECT k, n FROM big WHERE n > 3", "WITH o AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders), big AS (SELECT k, COUNT(*) AS n FROM o WHERE p > 200000 GROUP BY k) SELECT k, n FROM big WHERE n > 3")
both("c3_recursive_union_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 40) SELECT n, f FROM t")
both("c3_recursive_over_150_levels", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 150) SELECT n FROM t")
both("c6_recursive_with_join", "WITH RECURSIVE t(k, depth) AS (SELECT n_nationkey, 0 FROM {nation} WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM t JOIN {nation} n ON n.n_nationkey = t.k + 3) SELECT k, depth FROM t")

# Sort, limit, distinct, set operations
both("o1_sort_limit_nulls", "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id ASC NULLS LAST LIMIT 50")
both("o2_order_by_alias_position", "SELECT o_custkey AS k, o_totalprice AS p FROM {orders} ORDER BY p DESC NULLS FIRST, 1 ASC NULLS LAST")
both("o3_limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey NULLS LAST LIMIT 25 OFFSET 100")
both("o5_distinct", "SELECT DISTINCT lang, source FROM {documents}")
both("u1_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
both("u2_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
both("u3_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
both("u4_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
both("u5_minus", "SELECT p_size AS k FROM {part} MINUS SELECT n_nationkey FROM {nation}", "SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation")
both("u6_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
both("u8_precedence", "SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 3 UNION SELECT n_nationkey FROM {nation} WHERE n_nationkey < 9 INTERSECT SELECT n_regionkey FROM {nation}")
both("u8_parentheses", "(SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 8 UNION SELECT 30) INTERSECT (SELECT n_regionkey FROM {nation} ORDER BY n_regionkey LIMIT 12)")

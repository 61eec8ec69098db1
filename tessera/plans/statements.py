"""Queries and scripts as a user types them: text of the dialect, run by Engine, beside DuckDB's text for the same rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.engine import Engine
from tessera.errors import EngineError
from tessera.plans.catalogue import TABLES, register, table
from tessera.store.database import Database
from tessera.store.shared import shared_dir


def _named(*texts: str) -> list[str]:
    return [t for t in TABLES if any(re.search(rf"\b{t}\b", x) for x in texts)]


def typed(name: str, text: str, oracle: str | None = None, *params) -> None:
    """Register a query by its text in the dialect; oracle: DuckDB's spelling where it differs."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return Engine(spark).over(text, {t: table(spark, d, t) for t in _named(text)}, *params)

    register(name, query, oracle or text)


def script(name: str, statements: list[str], final: str, oracle: str) -> None:
    """Register the rows of a query after statements over a new database. A statement after ! must be refused."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        engine = Engine(spark, Database(spark, f"{shared_dir(spark)}/database-{uuid.uuid4().hex}"))
        for t in _named(*statements, final):
            engine.attach(t, table(spark, d, t))
        out = None
        for text in statements:
            try:
                out = engine.execute(text.removeprefix("!"))
            except EngineError:
                if not text.startswith("!"):
                    raise
            else:
                if text.startswith("!"):
                    raise EngineError(f"not refused: {text}")
        return out if final == "RETURNING" else engine.query(final)

    register(name, query, oracle)


# Predicates, functions and parameters
typed("f2_sql_whole_division", "SELECT o_orderkey, o_orderkey / 7 AS a, (o_custkey + 1) / 2 / 3 AS b, -7 / 2 AS c, o_totalprice / 2 > 1000 AS d FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS a, ((o_custkey + 1) // 2) // 3 AS b, -3 AS c, o_totalprice / 2 > 1000 AS d FROM orders")
typed("p9_sql_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type NOT ILIKE 'std%'")
typed("p11_sql_parameters", "SELECT c_custkey, c_acctbal > $2 AS rich FROM customer WHERE c_mktsegment <> $1", "SELECT c_custkey, c_acctbal > 1000 AS rich FROM customer WHERE c_mktsegment <> 'BUILDING'", "BUILDING", 1000)
typed("o1_sql_null_order", "SELECT doc_id, q FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x ORDER BY q DESC, doc_id LIMIT 50", "SELECT doc_id, q FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x ORDER BY q DESC NULLS FIRST, doc_id LIMIT 50")

# Aggregates
typed("a4_sql_real_aggregates", "SELECT n_regionkey, SUM(CAST(n_nationkey AS REAL)) AS s, AVG(CAST(n_nationkey AS REAL)) AS a, SUM(n_nationkey) / COUNT(*) AS m FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(sum(n_nationkey) AS REAL) AS s, CAST(avg(n_nationkey) AS REAL) AS a, CAST(sum(n_nationkey) // count(*) AS BIGINT) AS m FROM nation GROUP BY n_regionkey")
typed("a13_sql_group_by_all", "SELECT l_returnflag, 'all' AS c, COUNT(*) AS n FROM lineitem GROUP BY ALL")
typed("a13_sql_constants_over_nothing", "SELECT 1 AS one, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY ALL", "SELECT 1 AS one, CAST(0 AS BIGINT) AS n")
typed("a15_sql_rollup_over_nothing", "SELECT o_orderstatus, COUNT(*) AS n, SUM(o_custkey) AS s, GROUPING(o_orderstatus) AS g FROM orders WHERE o_orderkey < 0 GROUP BY ROLLUP(o_orderstatus)", "SELECT CAST(NULL AS VARCHAR) AS o_orderstatus, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s, 1 AS g")
typed("a14_sql_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, GROUPING(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority) HAVING COUNT(*) > 2 ORDER BY GROUPING(o_orderstatus, o_orderpriority), n", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, CAST(GROUPING(o_orderstatus, o_orderpriority) AS INTEGER) AS g FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority) HAVING COUNT(*) > 2 ORDER BY GROUPING(o_orderstatus, o_orderpriority), n")
typed("a8_sql_filter", "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS big, COUNT(DISTINCT o_custkey) AS c FROM orders GROUP BY o_orderstatus")

# Windows
typed("w1_sql_ranks", "SELECT c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr, NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS t FROM customer")
typed("w12_sql_distinct_over", "SELECT c_custkey, COUNT(DISTINCT c_mktsegment) OVER (PARTITION BY c_nationkey) AS n FROM customer")
typed("w13_sql_filter_over", "SELECT c_custkey, COUNT(*) FILTER (WHERE c_acctbal > 0) OVER (PARTITION BY c_nationkey) AS n FROM customer")
typed("w19_sql_named_windows", "SELECT c_custkey, MAX(c_custkey) OVER (w ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS m, COUNT(*) OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
typed("w21_sql_qualify", "SELECT c_nationkey, c_custkey FROM customer QUALIFY RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")

# Subqueries
typed("q4_sql_in_as_value", "SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier) AS here, c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END FROM orders) AS never FROM customer")
typed("q5_sql_quantified", "SELECT n_nationkey, n_nationkey > ALL (SELECT s_nationkey FROM supplier WHERE s_suppkey < 3) AS a, n_nationkey = ANY (SELECT s_nationkey FROM supplier) AS b, n_nationkey <> ALL (SELECT r_regionkey FROM region) AS c FROM nation")
typed("q6_sql_correlated", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS m FROM customer c")

# Recursion
typed("c3_sql_union_all", "WITH RECURSIVE r(n, s) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n + 5, s + 1 FROM r WHERE s < 3) SELECT n, s FROM r")
typed("c4_sql_union_in_subquery", "SELECT COUNT(*) AS n, MAX(k) AS m FROM (WITH RECURSIVE t(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT (k * 3 + 1) % 25 FROM t) SELECT k FROM t) x")
typed("c6_sql_seed_union_and_terms", "WITH RECURSIVE t(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 2 UNION SELECT r_regionkey FROM region WHERE r_regionkey = 4 UNION SELECT (k * 7) % 40 FROM t UNION SELECT (k + 10) % 40 FROM t) SELECT k FROM t", "WITH RECURSIVE t(k) AS ((SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 2 UNION SELECT r_regionkey FROM region WHERE r_regionkey = 4) UNION (SELECT CASE i WHEN 0 THEN (k * 7) % 40 ELSE (k + 10) % 40 END FROM t, (SELECT unnest([0, 1]) AS i) j)) SELECT k FROM t")

# Set operations
typed("u7_sql_by_name_chain", "SELECT c_nationkey AS k, c_mktsegment AS a FROM customer UNION ALL BY NAME SELECT s_nationkey AS k, s_name AS b FROM supplier UNION ALL BY NAME SELECT p_brand AS b, p_size AS k FROM part")
typed("u7_sql_by_name_nested", "SELECT k, COUNT(*) AS n, COUNT(a) AS a FROM (SELECT c_nationkey AS k, c_mktsegment AS a FROM customer UNION BY NAME SELECT s_nationkey AS k FROM supplier) u GROUP BY k")
typed("u7_sql_by_name_sorted", "SELECT 2 AS k, r_regionkey AS r FROM region UNION ALL BY NAME SELECT n_nationkey AS k FROM nation ORDER BY k DESC, r LIMIT 7", "SELECT k, r FROM (SELECT 2 AS k, r_regionkey AS r FROM region UNION ALL BY NAME SELECT n_nationkey AS k FROM nation) ORDER BY k DESC NULLS FIRST, r NULLS LAST LIMIT 7")
typed("u8_sql_precedence", "SELECT n_nationkey FROM nation WHERE n_nationkey < 3 UNION SELECT r_regionkey FROM region INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT 1")

# Changes: the state after a script
_N = "CREATE TABLE n (k INTEGER PRIMARY KEY, name TEXT, region INTEGER, note TEXT DEFAULT 'new')"
_FILL = "INSERT INTO n (k, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation"
script("d1_insert_values", [_N, "INSERT INTO n (k, name) VALUES (1, 'it''s'), (2, NULL)", "INSERT INTO n VALUES (3, 'c', 7, NULL)", "!INSERT INTO n (k) VALUES (9), (1)"], "SELECT k, name, region, note FROM n", "SELECT * FROM (VALUES (1, 'it''s', NULL, 'new'), (2, NULL, NULL, 'new'), (3, 'c', 7, NULL)) AS t(k, name, region, note)")
script("d2_insert_select", [_N, _FILL, "INSERT INTO n (k, name) SELECT CAST(c_custkey + 100 AS INTEGER), c_name FROM customer"], "SELECT k, name, region, note FROM n", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region, 'new' AS note FROM nation UNION ALL SELECT CAST(c_custkey + 100 AS INTEGER), c_name, NULL, 'new' FROM customer")
script("d3_do_nothing", [_N, _FILL, "INSERT INTO n (k, name) SELECT n_nationkey + 20, 'again' FROM nation ON CONFLICT (k) DO NOTHING"], "SELECT k, name FROM n", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT n_nationkey + 20, 'again' FROM nation WHERE n_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
script("d4_do_update", [_N, _FILL, "INSERT INTO n (k, name) SELECT n_nationkey + 20, 'more' FROM nation ON CONFLICT (k) DO UPDATE SET region = n.region + 10, note = excluded.name WHERE n.region > 1"], "SELECT k, name, region, note FROM n", "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey >= 20 AND n_regionkey > 1 THEN n_regionkey + 10 ELSE n_regionkey END AS region, CASE WHEN n_nationkey >= 20 AND n_regionkey > 1 THEN 'more' ELSE 'new' END AS note FROM nation UNION ALL SELECT n_nationkey + 20, 'more', NULL, 'new' FROM nation WHERE n_nationkey >= 5")
script("d5_update", [_N, _FILL, "UPDATE n SET region = region * 2, name = UPPER(name) WHERE k / 2 > 5", "UPDATE n SET k = k + 100 WHERE region = 0"], "SELECT k, name, region FROM n", "SELECT CASE WHEN n_regionkey = 0 THEN n_nationkey + 100 ELSE n_nationkey END AS k, CASE WHEN n_nationkey >= 12 THEN upper(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey >= 12 THEN n_regionkey * 2 ELSE n_regionkey END AS region FROM nation")
script("d6_delete", [_N, _FILL, "DELETE FROM n WHERE region = 2 OR k > 20"], "SELECT k FROM n", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 2 AND n_nationkey <= 20")
script("d7_returning", [_N, _FILL, "DELETE FROM n WHERE region > 2 RETURNING k, region * 10 AS r"], "RETURNING", "SELECT n_nationkey AS k, n_regionkey * 10 AS r FROM nation WHERE n_regionkey > 2")
script("d8_create_drop", [_N, "CREATE TABLE IF NOT EXISTS n (z INTEGER PRIMARY KEY)", _FILL, "CREATE TABLE other (k INTEGER PRIMARY KEY, f INTEGER REFERENCES n(k))", "!DROP TABLE n", "!CREATE TABLE bad (k INTEGER PRIMARY KEY, f INTEGER REFERENCES missing(k))", "DROP TABLE other", "DROP TABLE IF EXISTS other", "!DROP TABLE bad"], "SELECT k FROM n", "SELECT n_nationkey AS k FROM nation")
script("d9_alter", [_N, _FILL, "ALTER TABLE n ADD COLUMN size INTEGER NOT NULL DEFAULT 5", "ALTER TABLE n RENAME COLUMN name TO title", "ALTER TABLE n ALTER COLUMN note SET DEFAULT 'later'", "ALTER TABLE n ADD CONSTRAINT small CHECK (size < 50)", "INSERT INTO n (k, title) VALUES (100, 'x')", "!UPDATE n SET size = 60", "ALTER TABLE n DROP CONSTRAINT small", "UPDATE n SET size = 60 WHERE k = 1", "ALTER TABLE n ALTER COLUMN title SET NOT NULL", "!INSERT INTO n (k) VALUES (101)", "ALTER TABLE n ALTER COLUMN title DROP NOT NULL", "ALTER TABLE n ADD CONSTRAINT titles UNIQUE (title)", "!INSERT INTO n (k, title) VALUES (102, 'x')"], "SELECT k, title, note, size FROM n", "SELECT n_nationkey AS k, n_name AS title, 'new' AS note, CASE WHEN n_nationkey = 1 THEN 60 ELSE 5 END AS size FROM nation UNION ALL SELECT 100, 'x', 'later', 5")
script("d10_unique_index", [_N, _FILL, "!CREATE UNIQUE INDEX by_region ON n (region)", "CREATE UNIQUE INDEX by_name ON n (name)", "!INSERT INTO n (k, name) SELECT n_nationkey + 50, n_name FROM nation", "DROP INDEX by_name ON n", "INSERT INTO n (k, name) SELECT n_nationkey + 50, n_name FROM nation WHERE n_nationkey < 2"], "SELECT k, name FROM n", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT n_nationkey + 50, n_name FROM nation WHERE n_nationkey < 2")
script("d11_schema", [_N, "CREATE SCHEMA side", "USE SCHEMA side", "CREATE TABLE n (k INTEGER PRIMARY KEY)", "INSERT INTO n SELECT r_regionkey FROM region", "!USE SCHEMA nowhere"], "SELECT k FROM n", "SELECT r_regionkey AS k FROM region")
script("d12_check", ["CREATE TABLE c (k INTEGER PRIMARY KEY, v INTEGER NOT NULL CHECK (v >= 0), w INTEGER, CONSTRAINT less CHECK (v < w))", "INSERT INTO c SELECT n_nationkey, n_regionkey, n_regionkey + 1 FROM nation", "!INSERT INTO c VALUES (100, -1, 5)", "!INSERT INTO c VALUES (100, NULL, 5)", "!UPDATE c SET w = 2", "UPDATE c SET w = NULL WHERE k = 3"], "SELECT k, v, w FROM c", "SELECT n_nationkey AS k, n_regionkey AS v, CASE WHEN n_nationkey = 3 THEN NULL ELSE n_regionkey + 1 END AS w FROM nation")
_P = ["CREATE TABLE p (k INTEGER PRIMARY KEY)", "INSERT INTO p SELECT r_regionkey FROM region"]
script("d13_cascade", [*_P, "CREATE TABLE c (k INTEGER PRIMARY KEY, f INTEGER REFERENCES p(k) ON DELETE CASCADE ON UPDATE CASCADE)", "INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation", "!INSERT INTO c VALUES (100, 77)", "INSERT INTO c VALUES (100, NULL)", "DELETE FROM p WHERE k = 1", "UPDATE p SET k = 50 WHERE k = 2"], "SELECT k, f FROM c", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN 50 ELSE n_regionkey END AS f FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 100, NULL")
script("d13_set_null_and_restrict", [*_P, "CREATE TABLE c (k INTEGER PRIMARY KEY, f INTEGER REFERENCES p(k) ON DELETE SET NULL)", "CREATE TABLE r (k INTEGER PRIMARY KEY, f INTEGER REFERENCES p(k))", "INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation", "INSERT INTO r VALUES (1, 4)", "!DELETE FROM p WHERE k = 4", "DELETE FROM p WHERE k IN (0, 3)"], "SELECT k, f FROM c", "SELECT n_nationkey AS k, CASE WHEN n_regionkey NOT IN (0, 3) THEN n_regionkey END AS f FROM nation")
script("d14_transactions", [_N, _FILL, "BEGIN", "DELETE FROM n WHERE k < 10", "INSERT INTO n (k, name) VALUES (200, 'gone')", "ROLLBACK", "BEGIN", "UPDATE n SET name = 'kept' WHERE k = 3", "DELETE FROM n WHERE k = 4", "COMMIT"], "SELECT k, name FROM n", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN 'kept' ELSE n_name END AS name FROM nation WHERE n_nationkey <> 4")
script("d15_statement_savepoint", [_N, _FILL, "BEGIN", "UPDATE n SET region = 9 WHERE k = 0", "!INSERT INTO n (k) SELECT n_nationkey + 24 FROM nation", "!CREATE TABLE bad (k INTEGER PRIMARY KEY, f INTEGER REFERENCES missing(k))", "INSERT INTO n (k) VALUES (300)", "COMMIT"], "SELECT k, region FROM n", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 0 THEN 9 ELSE n_regionkey END AS region FROM nation UNION ALL SELECT 300, NULL")
script("q11_subqueries_in_changes", [_N, _FILL, "WITH big AS (SELECT n_regionkey AS r FROM nation WHERE n_nationkey > 20) DELETE FROM n WHERE region IN (SELECT r FROM big) AND k < (SELECT MAX(k) FROM n) - 5", "UPDATE n SET note = 'supplied' WHERE k IN (SELECT s_nationkey FROM supplier)", "WITH r AS (SELECT r_regionkey + 500 AS k, r_name AS name FROM region) INSERT INTO n (k, name) SELECT k, name FROM r"], "SELECT k, name, note FROM n", "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'supplied' ELSE 'new' END AS note FROM nation WHERE NOT (n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey > 20) AND n_nationkey < (SELECT max(n_nationkey) FROM nation) - 5) UNION ALL SELECT r_regionkey + 500, r_name, 'new' FROM region")

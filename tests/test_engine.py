"""Statements of the dialect: most against DuckDB's rows for the same tables, the rest against rows written out."""

import duckdb
import pytest

from tessera.dialect.rewrite import to_spark
from tessera.engine import Engine
from tessera.errors import Conflict, ConstraintViolation, EngineError, ParseError, Unsupported
from tessera.store.database import Database

SHIPS = [("ada", 1907, "tug", 12.5, True), ("boreas", 1931, "ferry", 40.25, None), ("cormo", 1931, "tug", None, False), ("delphin", 1988, None, 7.0, True), ("elba", 2004, "ferry", 40.25, False)]
LOADS = [(71, "ada", "coal", 30, 2), (72, "ada", "salt", 30, None), (73, "boreas", "cars", 12, 5), (74, "cormo", "coal", None, 1), (75, None, "ice", 9, 4), (76, "elba", "salt", 55, 2), (77, "elba", "cars", 8, 3)]
DEFINITIONS = [
    "CREATE TABLE ship (name TEXT PRIMARY KEY, built INTEGER NOT NULL, kind TEXT, draft DOUBLE, afloat BOOLEAN)",
    "CREATE TABLE load (no INTEGER PRIMARY KEY, ship TEXT, goods TEXT NOT NULL, tons INTEGER, deck INTEGER)",
]


def literal(row):
    return "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for v in row) + ")"


FILLS = [f"INSERT INTO {t} VALUES {', '.join(map(literal, rows))}" for t, rows in (("ship", SHIPS), ("load", LOADS))]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, Database(spark, f"file://{tmp_path_factory.mktemp('db')}"))
    for text in (*DEFINITIONS, *FILLS):
        e.execute(text)
    return e


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET default_null_order = 'nulls_last_on_asc_first_on_desc'")
    for text in (*DEFINITIONS, *FILLS):
        con.execute(text)
    return con


SAME = [
    "SELECT name, built - 1900 AS y FROM ship WHERE draft > 10 OR afloat ORDER BY y DESC, name",
    "SELECT kind FROM ship ORDER BY kind, name",
    "SELECT kind FROM ship ORDER BY kind DESC LIMIT 2",
    "SELECT goods, COUNT(*) AS n, SUM(tons) AS t FROM load GROUP BY goods HAVING COUNT(tons) > 0 ORDER BY goods",
    "SELECT name FROM ship WHERE name NOT IN (SELECT ship FROM load) ORDER BY name",
    "SELECT name FROM ship WHERE name NOT IN (SELECT ship FROM load WHERE ship IS NOT NULL) ORDER BY name",
    "SELECT name, name IN (SELECT ship FROM load) AS here, 'zora' NOT IN (SELECT ship FROM load WHERE no < 0) AS nowhere FROM ship ORDER BY name",
    "SELECT name, (SELECT MAX(l.tons) FROM load l WHERE l.ship = s.name) AS top FROM ship s ORDER BY name",
    "SELECT s.name, x.goods FROM ship s LEFT JOIN LATERAL (SELECT goods FROM load WHERE ship = s.name ORDER BY no DESC LIMIT 1) x ON TRUE ORDER BY s.name",
    "SELECT no, tons >= ALL (SELECT tons FROM load WHERE deck = 2) AS a, deck = ANY (SELECT deck FROM load WHERE tons > 20) AS b FROM load ORDER BY no",
    "SELECT no, SUM(tons) OVER (ORDER BY no) AS s FROM load ORDER BY no",
    "SELECT no, SUM(tons) OVER (ORDER BY tons RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS s FROM load WHERE tons IS NOT NULL ORDER BY no",
    "SELECT no, COUNT(DISTINCT goods) OVER (PARTITION BY ship) AS d, COUNT(*) FILTER (WHERE tons > 10) OVER (PARTITION BY ship) AS f FROM load ORDER BY no",
    "SELECT no, MIN(tons) OVER (w ORDER BY no) AS m FROM load WINDOW w AS (PARTITION BY goods) ORDER BY no",
    "SELECT no, goods FROM load QUALIFY ROW_NUMBER() OVER (PARTITION BY goods ORDER BY tons DESC, no) = 1 ORDER BY no",
    "SELECT kind, GROUPING(kind) AS g, COUNT(*) AS n FROM ship GROUP BY ROLLUP(kind) ORDER BY g, kind",
    "SELECT goods, deck, COUNT(*) AS n FROM load GROUP BY GROUPING SETS ((goods), (deck), (), (goods)) ORDER BY n, goods, deck",
    "SELECT SUM(tons) FILTER (WHERE goods LIKE 's%') AS salt FROM load",
    "SELECT ship FROM load EXCEPT ALL SELECT name FROM ship ORDER BY ship",
    "SELECT deck FROM load INTERSECT ALL SELECT deck FROM load WHERE no > 72 ORDER BY deck",
    "SELECT 4 AS v UNION SELECT deck FROM load WHERE no = 73 INTERSECT SELECT 5 ORDER BY v",
    "WITH RECURSIVE walk(v) AS (SELECT 3 UNION SELECT (v * 2) % 7 FROM walk) SELECT v FROM walk ORDER BY v",
    "WITH RECURSIVE up(v) AS (SELECT 5 UNION ALL SELECT v + 5 FROM up WHERE v < 20) SELECT SUM(v) AS s FROM up",
    "SELECT name AS k, built FROM ship WHERE built < 1930 UNION ALL BY NAME SELECT goods, ship AS k FROM load WHERE no = 73 ORDER BY k",
    "SELECT 'it''s' AS q, 'x_y' LIKE 'x_y' AS l, name ILIKE 'AD%' AS i FROM ship WHERE name = 'ada'",
    "SELECT 2.25 + 1 AS d, TIMESTAMP '2024-05-06 07:08:09' > TIMESTAMP '2023-01-01 00:00:00' AS t",
    "SELECT 1 AS one, MAX(tons) AS m FROM load WHERE no < 0 GROUP BY ALL",
    'SELECT name AS "Ship\'s Name" FROM ship WHERE kind IS NULL',
]


@pytest.mark.parametrize("sql", SAME)
def test_same_as_duckdb(engine, duck, sql):
    assert [tuple(r) for r in engine.query(sql).collect()] == duck.sql(sql).fetchall()


#: Where DuckDB reads the text otherwise.
WRITTEN = [
    ("SELECT 17 / 5 AS a, -17 / 5 AS b, 17 / 5.0 AS c, 100 / 7 / 2 AS d", [(3, -3, 3.4, 7)]),
    ("SELECT SUM(built) / COUNT(*) AS m FROM ship WHERE kind = 'tug'", [(1919,)]),
    ("SELECT COUNT(tons, deck) AS n, COUNT(*) AS a FROM load", [(5, 7)]),
    ("SELECT COUNT(*) AS n FROM load WHERE no < 0 GROUP BY ()", [(0,)]),
    ("SELECT deck, COUNT(*) AS n, GROUPING(deck) AS g FROM load WHERE no < 0 GROUP BY CUBE(deck)", [(None, 0, 1)]),
    ("SELECT MAX(v) AS m FROM (WITH RECURSIVE w(v) AS (SELECT 1 UNION SELECT (v + 3) % 10 FROM w) SELECT v FROM w) x", [(9,)]),
    ("SELECT SUM(CAST(tons AS REAL)) AS s FROM load WHERE deck = 2", [(85.0,)]),
]


@pytest.mark.parametrize(("sql", "rows"), WRITTEN)
def test_as_written(engine, sql, rows):
    assert [tuple(r) for r in engine.query(sql).collect()] == rows


def test_types(engine):
    kinds = dict(engine.query("SELECT 7 / 2 AS a, SUM(CAST(tons AS REAL)) AS b, AVG(CAST(tons AS REAL)) AS c, MAX(no) / 2 AS d FROM load").dtypes)
    assert kinds == {"a": "int", "b": "float", "c": "float", "d": "int"}


def test_parameters_and_explain(engine):
    assert [r.no for r in engine.query("SELECT no FROM load WHERE tons > $2 ORDER BY no LIMIT $1", 2, 10).collect()] == [71, 72]
    assert "parquet" in engine.execute("EXPLAIN SELECT no FROM load")
    before = engine.query("SELECT COUNT(*) FROM load").first()[0]
    assert "parquet" in engine.execute("EXPLAIN DELETE FROM load WHERE no > 72")
    assert engine.query("SELECT COUNT(*) FROM load").first()[0] == before


def test_views_of_the_user_stay(spark, engine):
    spark.range(3).createOrReplaceTempView("load")
    spark.range(4).createOrReplaceTempView("w")
    engine.query("WITH RECURSIVE w(v) AS (SELECT 1 UNION SELECT (v + 3) % 10 FROM w) SELECT COUNT(*) FROM w, load").collect()
    assert spark.table("load").count() == 3 and spark.table("w").count() == 4
    assert engine.query("SELECT COUNT(*) FROM load").first()[0] == len(LOADS)
    for name in ("load", "w"):
        spark.catalog.dropTempView(name)


def test_changes(engine):
    engine.execute("CREATE TABLE stock (goods TEXT PRIMARY KEY, tag TEXT UNIQUE, left_over INTEGER NOT NULL DEFAULT 4, CONSTRAINT few CHECK (left_over < 60))")
    assert sorted(tuple(r) for r in engine.execute("INSERT INTO stock (goods, tag) VALUES ('tea', 't1'), ('rye', 'r1') RETURNING goods, left_over * 2 AS d").collect()) == [("rye", 8), ("tea", 8)]
    engine.execute("INSERT INTO stock VALUES ('tea', 'zz', 30), ('oil', 'o1', 1) ON CONFLICT (goods) DO UPDATE SET left_over = stock.left_over + excluded.left_over WHERE excluded.left_over > 20")
    engine.execute("INSERT INTO stock (goods, tag) SELECT DISTINCT goods, goods FROM load WHERE deck > 2 ON CONFLICT DO NOTHING")
    rows = lambda: sorted(tuple(r) for r in engine.query("SELECT goods, tag, left_over FROM stock").collect())
    assert rows() == [("cars", "cars", 4), ("ice", "ice", 4), ("oil", "o1", 1), ("rye", "r1", 4), ("tea", "t1", 34)]
    engine.execute("BEGIN")
    engine.execute("DELETE FROM stock WHERE left_over < (SELECT MAX(left_over) FROM stock)")
    assert len(rows()) == 1
    engine.execute("ROLLBACK")
    assert [tuple(r) for r in engine.execute("UPDATE stock SET left_over = left_over / 3 WHERE tag = 't1' RETURNING *").collect()] == [("tea", "t1", 11)]
    with pytest.raises(EngineError):
        engine.execute("UPDATE stock SET left_over = 99 WHERE goods = 'ice'")
    engine.execute("DROP TABLE stock")


def test_a_failed_definition_leaves_nothing(engine):
    with pytest.raises(EngineError):
        engine.execute("CREATE TABLE crew (id INTEGER PRIMARY KEY, ship TEXT REFERENCES harbour(name))")
    with pytest.raises(EngineError):
        engine.execute("DROP TABLE crew")


def test_foreign_keys_hold_when_commits_meet(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/meet")
    db.create_table("p", {"k": "int"}, ["k"])
    db.create_table("c", {"k": "int", "f": "int"}, ["k"], foreign_keys=[{"columns": ["f"], "parent": "p"}])
    db.insert("p", spark.createDataFrame([(1,), (2,)], "k int"))
    one, two = db.begin(), db.begin()
    one.delete("p", "k = 2")
    two.insert("c", spark.createDataFrame([(1, 2)], "k int, f int"))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert db.table("c").count() == 0
    with pytest.raises(ConstraintViolation):
        db.insert("c", spark.createDataFrame([(1, 2)], "k int, f int"))


def test_grants(spark, engine):
    anna = Engine(spark, engine.database, "anna")
    with pytest.raises(Exception, match="(?i)not.found"):
        anna.query("SELECT no FROM load WHERE no < 72").collect()
    with pytest.raises(EngineError, match="no table"):
        anna.execute("DELETE FROM load WHERE no = 0")
    engine.execute("GRANT SELECT, DELETE ON load TO anna")
    engine.execute("GRANT INSERT ON SCHEMA main TO bert")
    assert anna.query("SELECT COUNT(*) FROM load").first()[0] == len(LOADS) and anna.execute("DELETE FROM load WHERE no = 0").count() == 0
    with pytest.raises(EngineError, match="no table"):
        anna.execute("UPDATE load SET tons = 0")
    engine.execute("REVOKE DELETE ON TABLE load FROM anna")
    with pytest.raises(EngineError, match="no table"):
        anna.execute("DELETE FROM load WHERE no = 0")
    with pytest.raises(Unsupported):
        anna.execute("GRANT SELECT ON load TO bert")


REFUSED = [
    "SELECT (2",
    "SELECT 2)",
    "SELECT 'open",
    "SELECT no FROM load TABLESAMPLE (9)",
    "SELECT MIN(no) OVER (ORDER BY no GROUPS 2 PRECEDING) FROM load",
    "SELECT " + "(" * 70 + "2" + ")" * 70,
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refusals(sql):
    with pytest.raises((ParseError, Unsupported)):
        to_spark(sql)


@pytest.mark.parametrize("term", ["SELECT MAX(v) + 1 FROM r", "SELECT v FROM r GROUP BY v", "SELECT a.v FROM r a JOIN r b ON a.v = b.v", "SELECT x.v FROM (SELECT 1 AS v) x LEFT JOIN r ON x.v = r.v"])
def test_refused_terms(engine, term):
    with pytest.raises(Unsupported):
        engine.query(f"WITH RECURSIVE r(v) AS (SELECT 1 UNION {term}) SELECT v FROM r")

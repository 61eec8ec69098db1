"""Correlated subqueries with ORDER BY and LIMIT keep their rows by that order, however the rows arrive."""

import os
from collections import defaultdict

import pytest

from tessera.dialect.rewrite import ordered_limits
from tessera.engine import Engine
from tessera.plans import catalogue, text  # noqa: F401

DATA = "/root/testdata/sf0.001"
SPILL = "spark.shuffle.spill.numElementsForceSpillThreshold"


@pytest.fixture
def spilling(spark):
    """Sorts that spill every 20 rows: rows that a sort holds equal leave it in no given order."""
    conf = spark._jvm.org.apache.spark.SparkEnv.get().conf()
    conf.set(SPILL, "20")
    yield
    conf.remove(SPILL)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_best_order_of_every_customer(spark, spilling):
    orders = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/orders.parquet").collect():
        orders[r.o_custkey].append((-r.o_totalprice, r.o_orderkey))
    expected = {r.c_custkey: min(orders[r.c_custkey], default=(None, None))[1] for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
    assert dict(map(tuple, catalogue.queries()["q6_correlated_order_limit"](spark, DATA).collect())) == expected


@pytest.fixture(scope="module")
def tables(spark):
    # Prices of one shop are 0, 3, 6 ... in no order; the good's number tells its price.
    sold = spark.range(600).selectExpr("id % 3 AS shop", "id AS good", "(id * 7 % 200) * 3 + id % 3 AS price").repartition(5)
    return {"shop": spark.range(4).withColumnRenamed("id", "shop"), "sold": sold}


def goods(shop):
    return [g for _, g in sorted(((g * 7 % 200) * 3 + g % 3, g) for g in range(600) if g % 3 == shop)]


CASES = [
    ("SELECT shop, (SELECT good FROM sold s WHERE s.shop = h.shop ORDER BY s.price DESC, s.good DESC LIMIT 1) AS v FROM shop h", lambda s: [goods(s)[-1]]),
    ("SELECT shop, (SELECT good AS price FROM sold s WHERE s.shop = h.shop ORDER BY 0 - s.price, -price LIMIT 1 OFFSET 2) AS v FROM shop h", lambda s: [goods(s)[-3]]),
    ("SELECT h.shop, x.v FROM shop h JOIN LATERAL (SELECT good AS v FROM sold s WHERE s.shop = h.shop ORDER BY s.price, s.good LIMIT 3) x ON TRUE", lambda s: goods(s)[:3]),
    ("SELECT h.shop, x.good AS v FROM shop h JOIN LATERAL (SELECT s.* FROM sold s WHERE s.shop = h.shop ORDER BY s.price + 1, s.good LIMIT 2) x ON TRUE", lambda s: goods(s)[:2]),
    ("SELECT h.shop, x.v FROM shop h JOIN LATERAL (SELECT good % 50 AS v FROM sold s WHERE s.shop = h.shop GROUP BY good % 50 ORDER BY SUM(s.price) DESC, good % 50 LIMIT 1) x ON TRUE", lambda s: [max(range(50), key=lambda m: (sum((g * 7 % 200) * 3 + g % 3 for g in goods(s) if g % 50 == m), -m))]),
]


@pytest.mark.parametrize("sql, of", CASES)
def test_subqueries_keep_rows_by_their_order(spark, spilling, tables, sql, of):
    found = Engine(spark).over(sql, tables)
    assert "row_number() windowspecdefinition(shop#" in (plan := found._jdf.queryExecution().optimizedPlan().toString())
    assert all("NULLS" in line for line in plan.splitlines() if "row_number()" in line)
    rows = {(s, v) for s in range(3) for v in of(s)}
    assert {tuple(r) for r in found.collect() if r.v is not None} == rows


def test_values_in_stay_three_valued(spark, tables):
    found = Engine(spark).over("SELECT shop, 1 IN (SELECT CASE WHEN good > 0 THEN NULL ELSE 5 END FROM sold ORDER BY price, good LIMIT 3) AS v FROM shop", tables)
    assert [r.v for r in found.collect()] == [None] * 4


def test_other_text_stays_as_it_is():
    for sql in (
        "SELECT a FROM {t} ORDER BY b LIMIT 2",
        "SELECT (SELECT MAX(b) FROM {u} u WHERE u.k = t.k) AS m FROM {t} t",
        "SELECT (SELECT u.b FROM {u} u WHERE u.k = t.k ORDER BY u.b DESC, 1 LIMIT 1) AS m FROM {t} t",
        "SELECT a FROM {t} WHERE a IN (SELECT DISTINCT b FROM {u} ORDER BY b LIMIT 3)",
        "(SELECT a FROM {t} UNION SELECT 1.5D ORDER BY a LIMIT 3)",
    ):
        assert ordered_limits(sql) == sql
    assert ordered_limits("SELECT (SELECT b x FROM {u} WHERE k = t.k ORDER BY c LIMIT 1) FROM {t}  t") == "SELECT (SELECT * EXCEPT (o0_) FROM (SELECT b x , c AS o0_ FROM {u} WHERE k = t.k ORDER BY o0_ LIMIT 1)) FROM {t} t"

"""Queries cover whole tables: results against brute force over all rows, not only against SQL with the same bounds."""

import os
from collections import defaultdict

import pytest

from tessera.plans import catalogue, composed, text  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_lateral_covers_every_customer(spark):
    orders = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/orders.parquet").collect():
        orders[r.o_custkey].append((-r.o_totalprice, r.o_orderkey))
    customers = [r.c_custkey for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()]
    expected = {(c, k, -p) for c in customers for p, k in sorted(orders[c])[:2]}
    found = [tuple(r) for r in catalogue.queries()["j5_lateral"](spark, DATA).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_projection_covers_every_order(spark):
    orders = {r.o_orderkey: r for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()}
    found = catalogue.queries()["p1_projection_aliases"](spark, DATA).collect()
    assert len(found) == len(orders)
    assert all(tuple(r)[1:-1] == tuple(orders[r.k]) and r.twice == r.o_totalprice * 2 for r in found)


def test_as_of_points_follow_the_table(spark):
    larger = "/root/testdata/sf0.01"
    log = [(r.user_id, r.event_id) for r in spark.read.parquet(f"{larger}/events.parquet").collect()]
    for name, tenths, low, high in [("k1_read_as_of", 7, 0, 10**9), ("k2_range_scan", 9, 10, 60)]:
        at = max(e for _, e in log) * tenths // 10
        newest = {}
        for user, event in log:
            if event <= at and low <= user < high:
                newest[user] = max(event, newest.get(user, event))
        found = catalogue.queries()[name](spark, larger).collect()
        assert {(r.key, r.seq) for r in found} == {(u, e) for u, e in newest.items() if e % 11}


def test_ordering_covers_every_row(spark):
    orders = [(r.o_custkey, r.o_totalprice) for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()]
    found = [tuple(r) for r in catalogue.queries()["o2_order_by_alias_position"](spark, DATA).collect()]
    assert found == sorted(orders, key=lambda r: (-r[1], r[0]))
    nations = {r.n_nationkey for r in spark.read.parquet(f"{DATA}/nation.parquet").collect()}
    sizes = {r.p_size for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    assert [r.k for r in catalogue.queries()["u10_order_by_output"](spark, DATA).collect()] == sorted(sizes - nations, reverse=True)

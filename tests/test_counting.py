"""Counts of joins come from the counts of their keys."""

from collections import Counter

import duckdb
import pytest

from tessera.plans import catalogue, composed, text  # noqa: F401

NAME = "j4_multi_self"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two nations hold nearly all; keys are NULL, repeated or met by nothing, names NULL or shared."""
    d = str(tmp_path_factory.mktemp("tables"))
    rows = {
        "region": ([(0, "a"), (1, "b"), (1, "b"), (2, "a"), (3, None), (None, "lost"), (9, "empty")], "r_regionkey int, r_name string"),
        "nation": ([(0, "p", 0), (1, "q", 1), (2, "r", 2), (2, "r", 2), (3, "s", 3), (4, "t", None), (None, "u", 0), (5, "v", 7)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    key = "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 < 6 THEN CAST(id % 50 AS INT) ELSE 1 END"
    spark.range(3000).selectExpr("id AS s_suppkey", f"{key} AS s_nationkey").write.parquet(f"{d}/supplier.parquet")
    spark.range(4000).selectExpr("id AS c_custkey", f"{key} AS c_nationkey").write.parquet(f"{d}/customer.parquet")
    return d


def rows_made(df):
    """The most rows that a step of a collected query gave out."""
    most, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        stack.extend(node.children().apply(i) for i in range(node.children().size()))
    return most


def test_pairs_are_counted_and_never_made(spark, tables):
    found = catalogue.queries()[NAME](spark, tables)
    ours = [tuple(r) for r in found.collect()]
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    theirs = con.sql(catalogue.oracle_sql()[NAME]).fetchall()
    assert Counter(ours) == Counter(theirs) and sum(n for _, n in ours) > 10**7
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in found.schema] == [("r_name", "string", True), ("n", "bigint", False)]
    assert 0 < rows_made(found) <= 4000


def test_no_rows_give_no_groups(spark, tables, tmp_path):
    for t in ("region", "nation", "supplier", "customer"):
        spark.read.parquet(f"{tables}/{t}.parquet").filter("FALSE" if t == "supplier" else "TRUE").write.parquet(f"{tmp_path}/{t}.parquet")
    assert catalogue.queries()[NAME](spark, str(tmp_path)).collect() == []

"""Registry of the relational queries and of the DuckDB SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, query: Query, oracle: str | None = None) -> None:
    """Add a query under a name not yet taken."""
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = query
    if oracle:
        _ORACLES[name] = oracle


def _flagship(spark: SparkSession, d: str) -> DataFrame:
    lineitem, orders, customer = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        lineitem.filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(revenue), 2).alias("revenue"))
        .filter(F.col("n_lines") > 10)
        .orderBy(F.col("revenue").desc_nulls_first(), "c_mktsegment", "o_orderpriority")
    )


register(
    "flagship",
    _flagship,
    """
    SELECT c_mktsegment, o_orderpriority, count(*) AS n_lines,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL HAVING count(*) > 10
    """,
)


def queries() -> dict[str, Query]:
    """All relational queries by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(_ORACLES)

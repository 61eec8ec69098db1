"""IN, NOT IN, ANY and ALL as values, with exact three-valued logic.

One row of statistics stands for the set: rows, non-null rows, least and greatest member; equality also needs the distinct
members, joined on the value. A correlated set has such a row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("=", "<>", "<", "<=", ">", ">=")


def _satisfied(op: str, x: Column, low: Column, high: Column, hit: Column) -> Column:
    """Whether some member y has x op y."""
    return {"<": x < high, "<=": x <= high, ">": x > low, ">=": x >= low, "=": hit, "<>": (low != x) | (high != x)}[op]


_OPPOSITE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "=": "<>", "<>": "="}


def quantified(df: DataFrame, x: str, op: str, members: DataFrame, every: bool, name: str, on: tuple[str, str] | None = None) -> DataFrame:
    """df with the value of x op ANY (or, if every, ALL) of members' first column, in the column name.

    on: (column of df, column of members) ties a correlated set to its outer row.
    """
    if op not in OPERATORS:
        raise ValueError(f"unknown comparison {op}")
    y = members.columns[0]
    key = [F.col(on[1]).alias("_k")] if on else []
    rows = members.select(*key, F.col(y).alias("_y"))
    by = ["_k"] if on else []
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count("_y").alias("_present"), F.min("_y").alias("_low"), F.max("_y").alias("_high"))
    out = df.join(stats, F.col(on[0]) == F.col("_k"), "left").drop("_k") if on else df.crossJoin(F.broadcast(stats))  # one row
    if op in ("=", "<>"):
        distinct = rows.filter("_y IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
        match = (F.col(x) == F.col("_y")) & (F.col(on[0]) == F.col("_k")) if on else F.col(x) == F.col("_y")
        out = out.join(distinct, match, "left").drop("_y", "_k")
    else:
        out = out.withColumn("_hit", F.lit(None).cast("boolean"))
    n, some = F.coalesce("_n", F.lit(0)), F.coalesce(F.col("_hit"), F.lit(False))
    decided = _satisfied(_OPPOSITE[op] if every else op, F.col(x), F.col("_low"), F.col("_high"), some)
    value = (
        F.when(n == 0, F.lit(every))
        .when(F.col(x).isNull(), F.lit(None).cast("boolean"))
        .when(F.coalesce(decided, F.lit(False)), F.lit(not every))
        .when(F.col("_present") < n, F.lit(None).cast("boolean"))
        .otherwise(F.lit(every))
    )
    return out.withColumn(name, value).drop("_n", "_present", "_low", "_high", "_hit")


def in_value(df: DataFrame, x: str, members: DataFrame, name: str, negated: bool = False, on: tuple[str, str] | None = None) -> DataFrame:
    """df with the value of x [NOT] IN (members): NULL where SQL says unknown."""
    return quantified(df, x, "<>" if negated else "=", members, negated, name, on)

"""Counts of joins from the counts of their keys, so that a key's rows are never paired.

A weighed table has one row for each combination of its columns, and n: how many rows it stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighed(df: DataFrame, *columns: str) -> DataFrame:
    """The combinations of some columns with their rows."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def join_weighed(left: DataFrame, right: DataFrame, keys: tuple[str, str], *columns: str) -> DataFrame:
    """The inner join of two weighed tables on a key of each, weighed by columns of either; NULL keys meet nothing."""
    pairs = left.withColumnRenamed("n", "n_left").join(right.withColumnRenamed("n", "n_right"), F.col(keys[0]) == F.col(keys[1]))
    return pairs.groupBy(*columns).agg(F.coalesce(F.sum(F.col("n_left") * F.col("n_right")), F.lit(0)).alias("n"))

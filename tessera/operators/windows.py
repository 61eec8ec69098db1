"""Window features that Spark's own windows lack, composed of those it has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def bigint_rank(rank: Column) -> Column:
    """Ranks are BIGINT here."""
    return rank.cast("bigint")


def unordered(*partition: str) -> WindowSpec:
    """A partition without an order, for ROW_NUMBER and NTILE: any order will do."""
    return Window.partitionBy(*partition).orderBy(F.lit(None).cast("int"))


def groups_frame(df: DataFrame, partition: Sequence, order: Sequence[Column], start: int, end: int, columns: dict) -> DataFrame:
    """Aggregates over a GROUPS frame: start to end peer groups from the current one.

    Peer groups are numbered by dense_rank in the window's own order, after which the frame is a RANGE over that number.
    columns maps a new name to a function of the window, such as lambda w: F.sum("x").over(w).
    """
    number = "_peer_group"
    while number in df.columns:
        number = f"_{number}"
    ranked = df.withColumn(number, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy(number).rangeBetween(start, end)
    return ranked.withColumns({name: make(frame) for name, make in columns.items()}).drop(number)


def _same_zero(x: Column) -> Column:
    return x + 0


def count_distinct_over(x: Column, window: WindowSpec) -> Column:
    """COUNT(DISTINCT x) OVER any frame; NULLs do not count."""
    return F.size(F.collect_set(x).over(window)).cast("bigint")


def sum_distinct_over(x: Column, window: WindowSpec, kind: str = "bigint") -> Column:
    """SUM(DISTINCT x) OVER any frame; NULL if it holds no value. -0.0 and 0.0 are one value."""
    values = F.collect_set(_same_zero(x)).over(window)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast(kind), lambda a, b: a + b.cast(kind)))


def avg_distinct_over(x: Column, window: WindowSpec) -> Column:
    """AVG(DISTINCT x) OVER any frame."""
    values = F.collect_set(_same_zero(x)).over(window)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values))


def filtered(x: Column, condition: Column) -> Column:
    """What AGG(x) FILTER (WHERE condition) aggregates: x where the condition is TRUE."""
    return F.when(condition, x)


def qualify(df: DataFrame, windows: dict[str, Column], condition: Column, keep: bool = False) -> DataFrame:
    """Rows for which a condition over window results is TRUE. The results are dropped unless kept."""
    found = df.withColumns(windows).filter(condition)
    return found if keep else found.drop(*windows)

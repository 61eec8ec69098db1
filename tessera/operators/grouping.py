"""Grouping extensions: bit strings, empty grouping sets over empty input, GROUP BY ALL with constants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_bits(*keys: str) -> Column:
    """GROUPING(k1, ..., kn): a bit for each key, the first most significant, 1 where the key is left out."""
    n = len(keys)
    if not 0 < n <= 31:
        raise ValueError("GROUPING takes 1 to 31 arguments")
    bits = [F.grouping(k).cast("int") * (1 << (n - 1 - i)) for i, k in enumerate(keys)]
    return reduce(lambda a, b: a + b, bits).cast("int")


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column], bits: Sequence[str] = (), bits_name: str = "grouping_bits") -> DataFrame:
    """Aggregates by several grouping sets in one pass; duplicate sets give duplicate rows.

    Empty sets give their row even over an empty input, as a global aggregate does. bits: keys for a GROUPING bit
    string, in the column bits_name.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    full = [[F.col(k) for k in s] for s in sets if s]
    names = [*keys, *([bits_name] if bits else [])]
    parts = []
    if full:
        grouped = df.groupingSets(full, *[F.col(k) for k in keys])
        extra = [grouping_bits(*bits).alias(bits_name)] if bits else []
        parts.append(grouped.agg(*extra, *aggregates))
    for _ in range(sum(not s for s in sets)):
        total = df.agg(*aggregates)
        all_out = {bits_name: F.lit((1 << len(bits)) - 1)} if bits else {}
        nulls = {k: F.lit(None).cast(df.schema[k].dataType) for k in keys}
        parts.append(total.select(*[c.alias(n) for n, c in nulls.items()], *[c.alias(n) for n, c in all_out.items()], *total.columns))
    return reduce(lambda a, b: a.unionByName(b), [p.select(*names, *[c for c in p.columns if c not in names]) for p in parts])


def rollup_sets(keys: Sequence[str]) -> list[list[str]]:
    """The grouping sets of ROLLUP."""
    return [list(keys[:n]) for n in range(len(keys), -1, -1)]


def cube_sets(keys: Sequence[str]) -> list[list[str]]:
    """The grouping sets of CUBE."""
    n = len(keys)
    return [[k for i, k in enumerate(keys) if not m >> (n - 1 - i) & 1] for m in range(1 << n)]


def group_by_all(df: DataFrame, keys: dict[str, Column], constants: dict[str, Column], aggregates: Sequence[Column]) -> DataFrame:
    """GROUP BY ALL: constants are no keys, so constants and aggregates alone give one row."""
    grouped = df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*aggregates) if keys else df.agg(*aggregates)
    return grouped.withColumns(constants) if constants else grouped


def count_all_present(*columns: str) -> Column:
    """COUNT(a, b, ...): rows in which no argument is NULL."""
    return F.count(F.when(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)), 1))


def count_distinct_present(*columns: str) -> Column:
    """COUNT(DISTINCT a, b, ...): distinct rows in which no argument is NULL."""
    return F.count_distinct(*[F.col(c) for c in columns])

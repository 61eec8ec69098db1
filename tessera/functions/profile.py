"""The profile of a result: for each column its NULLs, distinct values, least and greatest value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNORDERED = ("map", "variant")


def profile(df: DataFrame) -> DataFrame:
    """column, rows, nulls, distinct, least and greatest (as text), a row for each column of df in their order (position).

    One aggregation gives all columns. An empty result has its rows too, with zeros and NULLs. Columns that have no
    order (maps) have neither distinct, least nor greatest.
    """
    ordered = lambda f: not f.dataType.simpleString().startswith(_UNORDERED)
    cells = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema):
        c = F.col(f"_c{i}")
        cells.append((F.count(F.lit(1)) - F.count(c)).alias(f"n{i}"))
        if ordered(f):
            cells += [F.count_distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}")]
    one = df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).agg(*cells)
    none = lambda kind: F.lit(None).cast(kind)
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.col("_rows").alias("rows"), F.col(f"n{i}").alias("nulls"),
            (F.col(f"d{i}") if ordered(f) else none("long")).alias("distinct"), (F.col(f"a{i}") if ordered(f) else none("string")).alias("least"), (F.col(f"b{i}") if ordered(f) else none("string")).alias("greatest"),
        )
        for i, f in enumerate(df.schema)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

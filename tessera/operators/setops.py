"""Set operations: by name, and with typing that only widens numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import TypeMismatch

_RANK = {T.IntegerType: 0, T.LongType: 1, T.DecimalType: 2, T.FloatType: 3, T.DoubleType: 4}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type both sides widen to; anything but numbers must be equal."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) not in _RANK or type(b) not in _RANK:
        raise TypeMismatch(f"{a.simpleString()} and {b.simpleString()} have no common type")
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale, whole = max(a.scale, b.scale), max(a.precision - a.scale, b.precision - b.scale)
        return T.DecimalType(min(38, scale + whole), scale)
    low, high = sorted((a, b), key=lambda t: _RANK[type(t)])
    if isinstance(high, T.DecimalType):
        digits = 10 if isinstance(low, T.IntegerType) else 19
        return T.DecimalType(min(38, max(high.precision - high.scale, digits) + high.scale), high.scale)
    return T.DoubleType() if isinstance(high, T.FloatType) and not isinstance(low, T.IntegerType) else high


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns' common types and the left side's names."""
    if len(left.columns) != len(right.columns):
        raise TypeMismatch(f"{len(left.columns)} and {len(right.columns)} columns")
    types = [common_type(a.dataType, b.dataType) for a, b in zip(left.schema, right.schema, strict=True)]
    cast = lambda df: df.select(*[F.col(f"`{c}`").cast(t).alias(n) for c, t, n in zip(df.columns, types, left.columns, strict=True)])
    return cast(left), cast(right)


def union(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    """UNION [ALL]."""
    a, b = aligned(left, right)
    return a.unionAll(b) if all else a.unionAll(b).distinct()


def intersect(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    """INTERSECT [ALL]: ALL keeps the smaller count."""
    a, b = aligned(left, right)
    return a.intersectAll(b) if all else a.intersect(b)


def except_(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    """EXCEPT or MINUS [ALL]: ALL subtracts counts."""
    a, b = aligned(left, right)
    return a.exceptAll(b) if all else a.subtract(b)


def union_by_name(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    """UNION [ALL] BY NAME: the left columns, then those only on the right; what a side lacks is NULL."""
    for side in (left, right):
        low = [c.lower() for c in side.columns]
        if len(set(low)) < len(low):
            raise TypeMismatch("a column name occurs twice on one side")
    names = {c.lower(): c for c in right.columns}
    shared = [c for c in left.columns if c.lower() in names]
    if not shared:
        raise TypeMismatch("the sides share no column name")
    a, b = aligned(left.select(*shared), right.select(*[names[c.lower()] for c in shared]))
    kinds = dict(zip(shared, [f.dataType for f in a.schema], strict=True))
    retyped = lambda df, of: df.select(*[(F.col(f"`{c}`").cast(kinds[n]).alias(n) if (n := of(c)) in kinds else F.col(f"`{c}`")) for c in df.columns])
    by_low = {c.lower(): c for c in shared}
    out = retyped(left, lambda c: c).unionByName(retyped(right, lambda c: by_low.get(c.lower(), c)), allowMissingColumns=True)
    return out if all else out.distinct()

"""Multi-version key-value views over a log of (key, seq, op, value), as window-free aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(log: DataFrame, seq: int | Column, key: str = "key", order: str = "seq", op: str = "op") -> DataFrame:
    """Each key's newest version up to seq, without keys that it deletes. Partial aggregation keeps the shuffle to one row a key and task."""
    rest = [c for c in log.columns if c != key]
    newest = log.filter(F.col(order) <= seq).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_v"))
    return newest.select(key, "_v.*").filter(F.col(op) != "delete").select(*log.columns)


def range_scan(log: DataFrame, seq: int, low=None, high=None, limit: int | None = None, low_inclusive: bool = True, high_inclusive: bool = False, key: str = "key") -> DataFrame:
    """Keys from low to high as of seq, in order; with a limit, also truncated (whether more would follow)."""
    found = log
    if low is not None:
        found = found.filter(F.col(key) >= low if low_inclusive else F.col(key) > low)
    if high is not None:
        found = found.filter(F.col(key) <= high if high_inclusive else F.col(key) < high)
    rows = as_of(found, seq, key)
    if limit is None:
        return rows.orderBy(key)
    more = rows.orderBy(key).limit(limit + 1)
    at = Window.orderBy(key)  # over limit + 1 rows
    numbered = more.withColumn("_i", F.row_number().over(at)).withColumn("truncated", F.count(F.lit(1)).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > limit)
    return numbered.filter(F.col("_i") <= limit).drop("_i")


def compact(log: DataFrame, snapshots: list[int], key: str = "key", order: str = "seq", op: str = "op") -> DataFrame:
    """The newest version of each key and those that a live snapshot still sees; a deleted key that no snapshot sees goes."""
    bounds = sorted(set(snapshots))
    # The interval of live snapshots a version falls into: the newest of each interval stays.
    interval = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        interval = F.when(F.col(order) <= b, F.lit(i)).otherwise(interval)
    newest = Window.partitionBy(key, "_interval").orderBy(F.desc(order))
    oldest = Window.partitionBy(key).orderBy(order)
    kept = log.withColumn("_interval", interval).withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    # A tombstone below which nothing is left hides nothing.
    kept = kept.withColumn("_first", F.row_number().over(oldest))
    return kept.filter(~((F.col("_first") == 1) & (F.col(op) == "delete"))).drop("_interval", "_n", "_first")


def overlay(base: DataFrame, puts: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """Read-your-own-writes: base without the keys that a transaction touches, and its puts."""
    touched = puts.select(*keys).unionAll(deletes.select(*keys)).distinct()
    same = [base[k].eqNullSafe(touched[k]) for k in keys]
    return base.join(touched, same, "left_anti").unionByName(puts)

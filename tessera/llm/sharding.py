"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Counts per input partition (a small aggregate) and the exact shard sizes fix the margins of a matrix; its entries, how many
rows of each partition go to each shard, are drawn from the multivariate hypergeometric law. Each partition is
permuted locally, cut by its row of the matrix, and exchanged once; then shards are permuted again, in cells that
rows enter at random: a permutation within random cells, one after another, is a uniform one, so no task ever holds a
whole shard. Cells' first slots are prefix sums of their counts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import free_name

#: The matrix, and the cells' first slots, are broadcast up to this many numbers (64 MB), and joined by a shuffle beyond it.
BROADCAST_NUMBERS = 1 << 23
NUMPY_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among `drawn` from good + bad, for populations of any size."""
    if drawn <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return drawn
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    # Inversion from the mode outwards: the number of steps is a few standard deviations.
    lo, hi = max(0, drawn - bad), min(drawn, good)
    mode = min(hi, max(lo, (drawn + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    log_choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    u, left, right, p_left, p_right = rng.random(), mode, mode + 1, at_mode, 0.0
    p_right = at_mode * (good - mode) * (drawn - mode) / ((mode + 1) * (bad - drawn + mode + 1)) if mode < hi else 0.0
    while True:
        if left >= lo:
            if (u := u - p_left) <= 0:
                return left
            p_left *= left * (bad - drawn + left) / ((good - left + 1) * (drawn - left + 1)) if left > lo else 0.0
            left -= 1
        if right <= hi:
            if (u := u - p_right) <= 0:
                return right
            p_right *= (good - right) * (drawn - right) / ((right + 1) * (bad - drawn + right + 1)) if right < hi else 0.0
            right += 1
        if (left < lo or p_left < 1e-300) and (right > hi or p_right < 1e-300):
            return mode


def communication_matrix(blocks: list[int], cells: list[int], seed: int) -> np.ndarray:
    """Rows: blocks, columns: cells; the margins are exact and the entries hypergeometric."""
    rng = np.random.default_rng(seed)
    left = np.array(cells, dtype=np.int64)
    out = np.zeros((len(blocks), len(cells)), dtype=np.int64)
    for i, n in enumerate(blocks):
        total, need = int(left.sum()), int(n)
        if total < NUMPY_LIMIT and total:
            out[i] = rng.multivariate_hypergeometric(left, need, method="marginals")
        else:
            for j, room in enumerate(left.tolist()):
                if not need:
                    break
                out[i, j] = hypergeometric(rng, room, total - room, need)
                need -= out[i, j]
                total -= room
        left -= out[i]
    return out


def shard_sizes(n_rows: int, n_shards: int) -> list[int]:
    """Counts at most one apart."""
    return [n_rows // n_shards + (i < n_rows % n_shards) for i in range(n_shards)]


def uniform_shards(df: DataFrame, key: str, n_shards: int = 16, seed: int = 1, cell_rows: int = 2048) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in its shard): a uniform random permutation.

    key, with the other columns, tells rows apart; rows that are wholly alike are interchangeable. A null key counts as
    a value. An empty df gives no rows. Columns of df called shard or slot are replaced. df must have the same rows in
    the same partitions whenever it runs, as files and shuffles by keys have; where it has not, the query fails.
    """
    df = df.drop("shard", "slot")
    block, at, cell, ends, first = (free_name(df, n) for n in ("_block", "_at", "_cell", "_ends", "_first"))
    place, other = free_name(df, "_place"), free_name(df, "_other")
    whole = [F.col(f"`{c}`") for c in df.columns]
    # All columns are read, so that no other plan is chosen than for the shuffle itself.
    counted = df.select(F.spark_partition_id().alias("b"), F.xxhash64(*whole).alias("h")).groupBy("b").agg(F.count("h").alias("n"))
    counts = {r[0]: r[1] for r in counted.collect()}  # a row a partition
    n_rows = sum(counts.values())
    if not n_rows:
        return df.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    blocks = sorted(counts)
    matrix = communication_matrix([counts[b] for b in blocks], shard_sizes(n_rows, n_shards), seed)
    rows = [(b, e) for b, e in zip(blocks, matrix.cumsum(axis=1).tolist(), strict=True)]
    plan = df.sparkSession.createDataFrame(rows, f"{block} int, {ends} array<bigint>")
    plan = F.broadcast(plan) if matrix.size <= BROADCAST_NUMBERS else plan

    tie = F.xxhash64(*whole)
    mixed = lambda salt: F.xxhash64(F.lit(seed + salt), F.col(f"`{key}`"), tie)
    # The local permutation: rows sorted by a hash; their numbers then hold the partition and the place in it.
    numbered = df.withColumn(place, mixed(1)).sortWithinPartitions(place, F.col(f"`{key}`")).withColumn(place, F.monotonically_increasing_id())
    numbered = numbered.withColumn(block, F.shiftright(place, 33).cast("int")).withColumn(at, F.col(place).bitwiseAND((1 << 33) - 1)).join(plan, block, "left")
    shard = F.size(F.filter(ends, lambda e: e <= F.col(at)))
    whole_shard = F.when(F.coalesce(F.element_at(ends, -1), F.lit(0)) > F.col(at), shard).otherwise(F.raise_error(F.lit("df's partitions have changed while it was shuffled")).cast("int"))
    per_shard = max(1, math.ceil(n_rows / n_shards / cell_rows))
    dealt = numbered.withColumn("shard", whole_shard).withColumn(cell, F.pmod(F.xxhash64(F.lit(seed + 2), place), F.lit(per_shard)).cast("int")).drop(block, at, ends)
    sizes = dealt.groupBy(F.col("shard").alias(other), cell).agg(F.count(F.lit(1)).alias(first))
    before = Window.partitionBy(other).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(first, F.coalesce(F.sum(first).over(before), F.lit(0)))
    starts = F.broadcast(starts) if per_shard * n_shards <= BROADCAST_NUMBERS // 4 else starts
    again = Window.partitionBy("shard", cell).orderBy(F.xxhash64(F.lit(seed + 3), place), place)
    ranked = dealt.withColumn("slot", F.row_number().over(again).cast("long")).withColumnRenamed(cell, f"{cell}_")
    out = ranked.join(starts, (F.col("shard") == F.col(other)) & (F.col(f"{cell}_") == F.col(cell)))
    return out.withColumn("slot", F.col("slot") + F.col(first) - 1).select(*whole, F.col("shard"), F.col("slot"))

"""Exact nearest neighbours by cosine: int8 product tiles, error bounds, float re-ranking, merged heaps.

Vectors are scaled to unit length and quantised to int8. For a tile of queries and candidates one integer matrix
product gives all approximate cosines; with the quantisation errors' norms it bounds every true cosine from both
sides. A candidate whose upper bound falls below the k-th best lower bound of its query cannot be among the k nearest.
The survivors are computed in double precision on the original vectors; every tile keeps k per query, and the tiles'
heaps are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORE_SCHEMA = "query_id long, vec_id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, the code vectors' norms and the errors' norms of unit vectors."""
    scale = np.abs(x).max(axis=1, initial=1e-30) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.sqrt((back**2).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


STRIP = 1024


def tile_nearest(q_ids, q, c_ids, c, k: int) -> pd.DataFrame:
    """The k nearest candidates of each query inside one tile, exact. Products are made a strip of candidates at a time.

    A strip's candidates whose upper bound is below the k-th best score so far, or the strip's own k-th best lower bound, are
    out; the others' scores join the heaps.
    """
    q, c = np.asarray(q, np.float64), np.asarray(c, np.float64)
    # Scaling by the largest component first keeps squares away from overflow and underflow.
    q_top, c_top = np.abs(q).max(axis=1), np.abs(c).max(axis=1)
    qn, cn = q / q_top[:, None], c / c_top[:, None]
    q_len, c_len = np.sqrt((qn * qn).sum(axis=1)), np.sqrt((cn * cn).sum(axis=1))
    qc, qs, qb, qe = quantise(qn / q_len[:, None])
    cc, cs, _, ce = quantise(cn / c_len[:, None])
    # Products of int8 codes are whole numbers below 2**24 up to 1,040 dimensions: float32 sums of them are exact there.
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    codes = qc.astype(kind)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query's row, candidate's id, score
    floor = np.full(len(q), -np.inf)
    for s in range(0, len(c), STRIP):
        part = slice(s, s + STRIP)
        approx = (codes @ cc[part].astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, part]
        slack = qe[:, None] + qb[:, None] * ce[None, part] + 1e-12
        own = q_ids[:, None] == c_ids[None, part]
        lower = np.where(own, -np.inf, approx - slack)
        if lower.shape[1] >= k:
            floor = np.maximum(floor, np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k])
        qi, ci = np.nonzero((approx + slack >= floor[:, None]) & ~own)
        ci += s
        for t in range(0, len(qi), 65536):
            a, b = qi[t : t + 65536], ci[t : t + 65536]
            score = (qn[a] * cn[b]).sum(axis=1) / (q_len[a] * c_len[b])
            best = _heaps(*(np.concatenate(x) for x in zip(best, (a, c_ids[b], score), strict=True)), k)
        full = np.bincount(best[0], minlength=len(q)) == k
        last = np.full(len(q), -np.inf)
        last[best[0]] = best[2]  # rows are sorted: the last one written is the k-th
        floor = np.where(full, np.maximum(floor, last - 1e-12), floor)
    return pd.DataFrame({"query_id": q_ids[best[0]], "vec_id": best[1], "score": best[2]})


def _heaps(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, best first, ties to the smaller id."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    keep = order[rank < k]
    return row[rank < k], ids[keep], score[keep]


def _distinct(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors; of rows that share an id the one with the least vector."""
    ids, vectors = part["id"].to_numpy(), np.stack(part["v"])
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*vectors.T[::-1], ids))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
        ids, vectors = ids[order], vectors[order]
    return ids, vectors


def nearest(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 2048, candidate_block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest cosines over all rows but its own, ties to the smaller id.

    is_query: a condition over df that names the query set. Vectors that are null, zero, or hold null or non-finite
    components take no part; nor do rows without an id. Vectors are compared with those of their own length. Rows that
    share an id count as one vector, the least of theirs. Empty tables give no rows. Memory: the vectors of one tile
    (query_block and candidate_block) and a strip of query_block x STRIP products.
    """
    spark = df.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    ok = F.size(vec) > 0
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ok).filter(F.coalesce(finite & some, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("m")).first()
    if not sizes["m"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.withColumn("dim", F.size("v"))
    cuts_q = max(1, -(-sizes["m"] // query_block))
    cuts_c = max(1, -(-sizes["n"] // candidate_block), 12 // cuts_q)
    of = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.filter("q").withColumn("tq", of(1, cuts_q)).withColumn("tc", every(cuts_c)).select("dim", "tq", "tc", "id", "v")
    others = rows.withColumn("tc", of(2, cuts_c)).withColumn("tq", every(cuts_q)).select("dim", "tq", "tc", "id", "v")

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float)})
        return tile_nearest(*_distinct(left), *_distinct(right), k)

    found = queries.groupBy("dim", "tq", "tc").cogroup(others.groupBy("dim", "tq", "tc")).applyInPandas(tile, SCORE_SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

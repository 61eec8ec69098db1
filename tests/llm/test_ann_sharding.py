import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, sharding


def brute_nearest(rows, is_query, k):
    ok = {}
    for i, v in rows:
        if i is None or v is None or len(v) != 4 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = np.array(v, float)
    out = {}
    for i in ok:
        if is_query(i):
            near = sorted((-(ok[i] @ ok[j]) / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])), j) for j in ok if j != i)[:k]
            out[i] = near
    return out


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [0.0] * 4), (402, [1.0, None, 0.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (405, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, 5, query_block=8, candidate_block=64).collect()
    want = brute_nearest(rows, lambda i: i % 10 == 0, 5)
    assert {r["query_id"] for r in got} == set(want)
    for q, near in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([m[2] for m in mine], [-n[0] for n in near], atol=1e-12)
        assert len({m[1] for m in mine}) == 5
        if q in range(300, 340):
            assert [m[1] for m in mine] == [i for i in (7, *range(300, 340)) if i != q][:5]


def test_nearest_of_nothing_and_of_few(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, F.lit(True)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in ann.nearest(few, F.lit(True)).collect()) == [(0, 1), (1, 0)]
    mixed = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.vec_id, round(r.score, 6)) for r in ann.nearest(mixed, F.lit(True)).collect())
    assert got == [(0, 1, 1.0), (1, 0, 1.0), (2, 3, 0.707107), (3, 2, 0.707107)]


def test_strips_change_nothing(monkeypatch):
    rng = np.random.default_rng(9)
    q, c = rng.normal(size=(20, 8)), np.repeat(rng.normal(size=(60, 8)), 5, axis=0)
    ids = np.arange(300)
    whole = ann.tile_nearest(ids[:20] * 3, q, ids, c, 7)
    monkeypatch.setattr(ann, "STRIP", 11)
    assert ann.tile_nearest(ids[:20] * 3, q, ids, c, 7).equals(whole)
    for i in range(20):
        score = c @ q[i] / np.sqrt((c * c).sum(axis=1) * (q[i] @ q[i]))
        want = [j for j in np.lexsort((ids, -score.round(12))) if j != 3 * i][:7]
        assert whole["vec_id"][whole["query_id"] == 3 * i].tolist() == want


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_shards_are_a_permutation_of_exact_sizes(spark, n):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i % 9}", i) for i in range(n)], "doc_id long, text string, SHARD long")
    rows = sharding.uniform_shards(df, "doc_id", 4, cell_rows=50).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n // 4 + (s < n % 4)))


def test_shards_with_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a")] * 60 + [(None, "b")] * 60 + [(3, "c")] * 40, "doc_id long, text string")
    rows = sharding.uniform_shards(df, "doc_id", 3, cell_rows=10).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(3) for i in range(160 // 3 + (s < 1))]
    assert sum(r.text == "b" for r in rows) == 60


def test_clashing_columns_and_many_partitions(spark):
    names = "doc_id, _block, _at, _cell, _cell_, _ends, _first, _place, _other, _coarse, Shard"
    df = spark.range(500).selectExpr("id AS doc_id", *[f"1 AS {n}" for n in names.split(", ")[1:]]).repartition(13, "doc_id")
    rows = sharding.uniform_shards(df, "doc_id", 4, cell_rows=20).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(4) for i in range(125)] and len({r.doc_id for r in rows}) == 500


def test_shuffle_is_uniform(spark):
    """Every row is about as likely in each shard, over many seeds."""
    hits = np.zeros(4)
    for seed in range(12):
        df = spark.range(40).withColumnRenamed("id", "doc_id")
        for r in sharding.uniform_shards(df, "doc_id", 4, seed, cell_rows=7).filter("doc_id < 10").collect():
            hits[r.shard] += 1
    assert hits.sum() == 120 and hits.min() > 12


def test_hypergeometric_of_large_populations():
    rng = np.random.default_rng(2)
    drawn = np.array([sharding.hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(300)])
    assert abs(drawn.mean() - 750_000) < 150 and 330 < drawn.std() < 540
    m = sharding.communication_matrix([2 * 10**9, 5], [10**9, 10**9 + 5], 3)
    assert m.sum(axis=0).tolist() == [10**9, 10**9 + 5] and m.sum(axis=1).tolist() == [2 * 10**9, 5]


def test_crc_is_zlib(spark):
    text = "naïve ✓"
    assert spark.range(1).select(F.crc32(F.lit(text).cast("binary"))).first()[0] == zlib.crc32(text.encode())

"""Every opN_ query on a small table of odd documents, against plain Python straight from its contract."""

import hashlib
import math
import random
import zlib
from functools import lru_cache
from itertools import permutations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, queries, secrets

from .test_jaccard import brute as brute_classes
from .test_ngram_lm import Plain, tokens
from .test_quality_secrets_mixing import brute_measures
from .test_suffix_dedup import brute as brute_repeats
from .test_tokens_packing_wavelet import plain


def documents():
    rng = random.Random(12)
    words = [f"{rng.choice('aeiou')}{rng.choice('bcdfg')}{i}" for i in range(150)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 30, 90, 300])))
        if i % 9 == 4 and rows:
            text = rng.choice(rows)[1]
        if i % 9 == 5 and rows:
            text = (rng.choice(rows)[1] or "") + " " + passage
        if i % 9 == 6:
            text += f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" password: {rng.choice(words)} commit {hashlib.sha1(str(-i).encode()).hexdigest()}'
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "word " * 3000), (204, "é 🙂 ü " * 60), (205, passage.upper()), (206, "a" * 2000)]
    return [(i, t, "en", f"src{i % 4}" if i % 11 else None, len(t or "")) for i, t in rows]


ROWS = documents()
TEXTS = [(r[0], r[1]) for r in ROWS]
LABELS = [(i, int(i % 3 > 0), int(i % 17 == 1)) for i in range(0, 90, 2)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], 0) for i in range(160)] + [(161, None, 0), (200, [0.0] * 6, 0), (250, [1.0] * 6, 1), (251, [2.0] * 6, 1), (252, [1.0] * 6, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def run(spark, name, folder):
    return queries.QUERIES[name](spark, folder).collect()


def test_op1(spark, folder):
    pattern = regex.compile(secrets.PATTERN)
    want = {(i, k, m.start(), len(m.group()), hashlib.sha256(m.group().encode()).hexdigest()) for i, t in TEXTS for k, m in enumerate(pattern.finditer(t or ""))}
    got = run(spark, "op1_forest_secrets", folder)
    assert {(r.doc_id, r.finding, r.start, r.length, r.value_sha256) for r in got} == want and len(got) == len(want)
    assert all(0 <= r.score <= 1 and r.secret == (r.score >= 0.5) for r in got)
    hexes = {hashlib.sha256(hashlib.sha1(str(i).encode()).hexdigest().encode()).hexdigest() for i in range(90)}
    assert all(r.secret for r in got if r.value_sha256 in hexes)


def test_op2(spark, folder):
    got = run(spark, "op2_swap_packing", folder)
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == {i for i, _ in TEXTS}
    for i, text in TEXTS:
        ids, at = np.append(plain(text), np.uint32(2)), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == 1024 if k else 0 < r.length <= 1024
            at += r.length
        assert at == len(ids)
    for places in bins.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) == math.ceil(sum(r.length for r in got) / 1024)


@lru_cache(None)
def fewest(items, capacity):
    """The least number of bins by trying all orders of first fit."""
    best = len(items)
    for order in set(permutations(items)):
        bins = []
        for x in order:
            for k, b in enumerate(bins):
                if b + x <= capacity:
                    bins[k] += x
                    break
            else:
                bins.append(x)
        best = min(best, len(bins))
    return best


def test_packing_is_nearly_the_best_possible():
    rng, worse = random.Random(3), 0
    for _ in range(60):
        items = tuple(sorted(rng.randint(1, 12) for _ in range(7)))
        histogram = {x: items.count(x) for x in items}
        n = sum(k for _, k in packing.improve(packing.best_fit(histogram, 15), 15))
        assert fewest(items, 15) <= n <= fewest(items, 15) + 1
        worse += n > fewest(items, 15)
    assert worse <= 3


def test_op3(spark, folder):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op3_parity_jaccard", folder)} == brute_classes(TEXTS)


def test_op4(spark, folder):
    """The fit against nonnegative least squares over all rates at once."""
    rows = run(spark, "op4_soft_mixing", folder)
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in TEXTS)
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(tokens_of(t)) for i, t in TEXTS}
    p = np.array([[r.p_low, r.p_good, r.p_toxic] for r in rows])
    n, rate = np.array([r.n_tokens for r in rows], float), np.array([r.rate for r in rows])
    goal = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    a = (p * n[:, None]).T / n.sum()
    x = np.ones(len(rows))
    step = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20000):
        x = np.maximum(0, x - step * a.T @ (a @ x - goal))
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    ours, best = np.linalg.norm(a @ rate - goal), np.linalg.norm(a @ x - goal)
    # Posteriors of 45 labelled texts are weak, and no rates meet the targets: then the fit comes near the least residual.
    assert best > 0.01 and ours <= 1.3 * best and abs(np.abs(a @ rate - goal).max() - rows[0].residual) < 1e-9
    assert all(abs(r.copies - r.rate) < 1 for r in rows)


def test_fit_meets_targets_that_can_be_met(spark):
    rng = np.random.default_rng(6)
    z = np.exp(3 * rng.normal(size=(400, 3)) + np.array([0, 1, -1]))
    rows = spark.createDataFrame([(int(rng.integers(1, 400)), *map(float, p)) for p in z / z.sum(axis=1, keepdims=True)], "_n long, _p0 double, _p1 double, _p2 double")
    steps, residual = mixing.fit_rates(rows, [0.03, 0.96, 0.01])
    assert residual <= 1e-4 and len(steps) <= 20
    columns = [F.col(f"_p{i}") for i in range(3)]
    total, *sums = rows.withColumn("r", mixing.rate(columns, steps)).agg(F.sum("_n"), *[F.sum(F.col("_n") * F.col("r") * c) for c in columns]).first()
    assert np.allclose(np.array(sums) / total, [0.03, 0.96, 0.01], atol=1.1e-4)


def tokens_of(text):
    return (text or "").encode().split()


def test_op5(spark, folder):
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    model = Plain([t for i, t in TEXTS if not out(i)], 3)
    got = {r.doc_id: r for r in run(spark, "op5_kneser_ney", folder)}
    assert len(got) == len(TEXTS)
    for i, t in TEXTS:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(i), len(tokens(t)), sum(model.uni[x] > 0 for x in tokens(t)), model.n)
        assert math.isclose(r.base_score, model.base(t), rel_tol=1e-9) and math.isclose(r.score, model.score(t), rel_tol=1e-9)


def test_op6(spark, folder):
    got = {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in run(spark, "op6_run_length_dedup", folder)}
    assert got == brute_repeats(TEXTS)


def test_op7(spark, folder):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding and any(r.embedding)}
    got = {}
    for r in run(spark, "op7_block_matrix_ann", folder):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in vectors if i % 50 == 0}
    for q, near in got.items():
        cosine = {i: v @ vectors[q] / np.sqrt((v @ v) * (vectors[q] @ vectors[q])) for i, v in vectors.items() if i != q}
        want = sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:5]
        assert [(k, i) for k, i, _ in sorted(near)] == list(enumerate(want, 1))
        assert np.allclose([s for *_, s in sorted(near)], [cosine[i] for i in want], atol=1e-12)


def test_op8(spark, folder):
    got = {r.doc_id: r for r in run(spark, "op8_host_rules", folder)}
    for i, t in TEXTS:
        n, chars, symbols, dup, repeat = brute_measures(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and not (r.kept and r.base_failed)


def test_op9(spark, folder):
    got = {r.doc_id: r for r in run(spark, "op9_wavelet_shards", folder)}
    start = 0
    for i, t in sorted(TEXTS):
        ids = np.append(plain(t), np.uint32(0))
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op10(spark, folder):
    got = run(spark, "op10_hypergeometric_shards", folder)
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in TEXTS}
    n, extra = divmod(len(TEXTS), 16)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(16) for k in range(n + (s < extra))]

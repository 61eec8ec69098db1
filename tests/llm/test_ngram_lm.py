import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import files, ngram_lm
from tessera.llm.shared import fresh_path

GAP = re.compile("[ \t-\r]+")


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*(w for w in GAP.split(lower) if w), "<end>"]


class Plain:
    """Modified Kneser-Ney from its definition, by recursion over the orders."""

    def __init__(self, texts, order):
        self.order = order
        self.uni = Counter(x for t in texts for x in tokens(t))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.counts = {order: Counter(g for t in texts for g in self.grams(t))}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.after = {k: defaultdict(list) for k in self.counts}
        for k, table in self.counts.items():
            for g, n in table.items():
                self.after[k][g[:-1]].append(n)
        self.d = {k: ngram_lm.discounts(*[sum(c == x for c in table.values()) for x in (1, 2, 3, 4)]) for k, table in self.counts.items()}

    def grams(self, text):
        t = ["<begin>"] * (self.order - 1) + tokens(text)
        return [tuple(t[i : i + self.order]) for i in range(len(t) - self.order + 1)]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (self.v + 1)
        row = self.after[k].get(gram[:-1])
        if not row:
            return self.p(gram[1:])
        c, d = self.counts[k].get(gram, 0), self.d[k]
        return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in row) * self.p(gram[1:])) / sum(row)

    def score(self, text):
        return sum(math.log10(self.p(g)) for g in self.grams(text))

    def base(self, text):
        return sum(math.log10((self.uni[b] + 0.1) / (self.n + 0.1 * (self.v + 1))) for b in tokens(text))


def corpus():
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(200)]
    return [*rows, (500, None), (501, " \n"), (502, rows[5][1].upper()), (503, "hot word " * 1500), (None, "x y")]


@pytest.mark.parametrize(("size", "order"), [(24 << 20, 3), (300, 2), (300, 3), (9000, 4)])
def test_scores_equal_the_definition(spark, monkeypatch, size, order):
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", size)
    monkeypatch.setattr(ngram_lm, "COMBINE", 5 * size)
    rows = corpus()
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    plain = Plain([t for i, t in rows if not out(i)], order)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score")
    got = {r.doc_id: r for r in ngram_lm.train_and_score(df, order=order).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out(i), len(tokens(t)), plain.n)
        assert r.n_known == sum(plain.uni[x] > 0 for x in tokens(t))
        assert math.isclose(r.base_score, plain.base(t), rel_tol=1e-9) and math.isclose(r.score, plain.score(t), rel_tol=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(order):
    plain = Plain([t for _, t in corpus()], order)
    for a in [("<begin>",), ("w1",), ("hot",), ("never seen",)]:
        context = (a * 2)[: order - 1]
        assert math.isclose(sum(plain.p((*context, b)) for b in [*plain.uni, "another"]), 1, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    (r,) = ngram_lm.train_and_score(df).collect()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0 and r.base_score == 0
    assert ngram_lm.train_and_score(df.limit(0)).count() == 0


def test_files_come_back(spark):
    path = f"{fresh_path(spark, 'arrays')}/x"
    arrays = [np.arange(5, dtype=np.uint64), np.arange(3, dtype=np.uint8), np.zeros(0, np.int64), np.arange(7, dtype=np.uint32)]
    files.save(path, arrays)
    assert [a.tolist() for a in files.load(path)] == [a.tolist() for a in arrays]


def test_hashes_that_differ_in_low_bits_only_are_ordered_and_kept_apart():
    rng = np.random.default_rng(5)
    keys = np.concatenate([rng.integers(0, 1 << 63, 3000, np.uint64), (np.uint64(7) << np.uint64(40)) + rng.integers(0, 50, 3000).astype(np.uint64)])
    for some in (rng.permutation(keys), np.arange(5000, dtype=np.uint64)[::-1], keys[:1], keys[:0]):
        order, found = ngram_lm.by_hash(some)
        wanted = np.argsort(some, kind="stable")
        assert (order == wanted).all() and (found == some[wanted]).all()
    a, b = np.unique(keys[:4000]), np.unique(keys[2000:])
    assert (ngram_lm.union(a, b) == np.unique(keys)).all() and not len(ngram_lm.union(a[:0], a[:0]))
    for first, second in ((rng.integers(0, 99, 500, np.uint32), rng.integers(0, 99, 500, np.uint32)), (rng.integers(0, 1 << 62, 500, np.uint64), None)):
        order = ngram_lm.by_numbers(first, second)
        assert (order == np.lexsort((first if second is None else second, first))).all()


def test_small_batches_are_scored_together(spark, tmp_path, monkeypatch):
    texts = [f"a b c{i % 3} d{i % 5} a b" for i in range(40)]
    about = ngram_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), path=f"file://{tmp_path}/lm")
    rows = pa.table({"doc_id": pa.array(range(40), pa.int64()), "held_out": [False] * 40, "text": texts})
    calls, score = [], ngram_lm.Model.score
    monkeypatch.setattr(ngram_lm.Model, "score", lambda self, *a: calls.append(1) or score(self, *a))
    run = lambda n: pa.Table.from_batches(ngram_lm._scored(about)(iter(rows.to_batches(max_chunksize=n))))
    together = run(5)
    assert len(calls) == 1
    monkeypatch.setattr(ngram_lm, "SCORED", 1)
    assert run(1).equals(together) and len(calls) == 41

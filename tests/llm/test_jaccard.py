import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard
from tessera.llm.graph import components
from tessera.llm.words import shingle_sets, word_hashes

GAP = re.compile("[ \t-\r]+")


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in GAP.split(lower) if w]


def shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcdefgh')}{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            w = words_of(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                if w:
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[at], rng.choice(vocabulary)]])
            texts.append(rng.choice([" ", "\n", "\t "]).join(w) if rng.random() < 0.5 else " ".join(w).upper())
        elif kind < 0.7:
            texts.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 20, 40]))]))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 8, 30, 60, 90, 300]))))
    return [None, "", " \t\n", "é É a b c", "É é a b c", *texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n_shingles")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df).collect()}
    assert got == brute(rows)


def test_blocks_and_chunks_change_nothing(spark, monkeypatch):
    rows = list(enumerate(corpus(3, 150)))
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "CHUNK", 2)
    monkeypatch.setattr(jaccard, "COPY_SHARD", 1)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 1)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_null_ids_empty_tables_and_repeated_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (3, text), (9, None), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.classes(df).collect())
    assert got == [(-1, 4, None), (3, 4, 3), (5, 4, 3), (5, 4, 3), (9, 0, 9), (9, 0, 9)]
    assert jaccard.classes(df.limit(0)).count() == 0


def test_linked_sets_share_a_signature():
    """The pigeonhole guarantee, and the sketches' lower bound, on random linked sets of all sizes."""
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 40, 100, 127, 128, 130, 500, 1023, 1024, 3000, 9000]:
        for _ in range(15):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            gone, new = 0, 0
            while 100 * (n - gone - 1) >= 80 * (n + new) and rng.random() < 0.97:
                gone += 1
            while 100 * (n - gone) >= 80 * (n + new + 1) and rng.random() < 0.97:
                new += 1
            b = np.concatenate([a[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            assert set(jaccard.signatures(a)) & set(jaccard.signatures(b))
            x, y = jaccard.parity_sketch(a), jaccard.parity_sketch(b)
            size = min(len(x), len(y))
            apart = int(np.bitwise_count(jaccard.folded(x, size) ^ jaccard.folded(y, size)).sum())
            assert apart <= gone + new and 9 * apart <= len(a) + len(b)


def test_words_and_shingles_equal_plain_python(monkeypatch):
    import tessera.llm.words as module

    texts = [*corpus(7, 60), "x" * 500 + " y " + "z" * 300, "a\x0bb\x0cc\x1cd  e", "퟿ ok"]
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(module, "CHUNK", chunk)
        seen = {}
        column = pa.array(["skip", *texts, "skip"]).slice(1, len(texts))
        at = 0
        for i, j, hashes, ends in word_hashes(column):
            begin = 0
            for row, end in zip(range(i, j), ends.tolist(), strict=True):
                words = words_of(texts[row])
                assert len(words) == end - begin
                for w, h in zip(words, hashes[begin:end].tolist(), strict=True):
                    assert seen.setdefault(w, h) == h
                begin = end
            at = j
        assert at == len(texts) and len(set(seen.values())) == len(seen)
        assert [len(s) for s in shingle_sets(column)] == [len(shingles(t)) for t in texts]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (901, 905), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900, 905: 900}
    assert components(links.limit(0)).count() == 0


def test_bands_hold_the_partners_of_their_sets():
    for n in [*range(1, 400), 5000, 12345, 10**7]:
        own = jaccard.bisect_right(jaccard.EDGES, n) - 1
        assert jaccard.EDGES[own] <= n < jaccard.EDGES[own + 1] and 5 * n // 4 < jaccard.EDGES[own + 2]


def test_signatures_are_of_segments_at_every_size():
    """A quarter of the hashes in keys, each over several hashes."""
    rng = np.random.default_rng(2)
    for n in (60, 100, 400, 1000, 5000):
        found = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert len(jaccard.signatures(found)) <= 0.5 * n + 2
        for k, keys, weight in jaccard.segment_keys(found):
            heaviest = np.sort(weight)[::-1][: k + 1]
            assert len(keys) > k and heaviest.mean() > 2.5 and (heaviest >= 2).mean() > 0.9


def test_words_of_a_regular_build_do_not_collide(spark):
    """Thue-Morse words are equal under every polynomial modulo a power of two."""
    a, b = "x", "y"
    for _ in range(11):
        a, b = a + b, b + a
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.classes(df).collect()) == [(1, 1), (2, 2), (3, 1)]
    assert len({tuple(h.tolist()) for *_, h, _ in (next(word_hashes(pa.array([t]))) for t in (a, b))}) == 2

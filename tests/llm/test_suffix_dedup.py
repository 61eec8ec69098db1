import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as sd
from tessera.llm.run_index import RunIndex, joined, suffixes


def brute(rows, w=50):
    """Every window against all earlier documents, straight from the definition."""
    out, seen = {}, {}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode())
    for i in sorted(texts):
        for x in texts[i]:
            covered = bytearray(len(x))
            for p in range(len(x) - w + 1):
                if x[p : p + w] in seen:
                    covered[p : p + w] = b"\1" * w
            left = bytes(b for b, c in zip(x, covered) if not c)
            n_spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
            out.setdefault(i, []).append((len(x), sum(covered), n_spans, hashlib.sha256(left).hexdigest()))
        for x in texts[i]:
            for p in range(len(x) - w + 1):
                seen[x[p : p + w]] = i
    return {i: sorted(v) for i, v in out.items()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "énd", "a", "thion", "x" * rng.randint(1, 12), f"q{rng.randint(0, 99)}"])
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(8, 40)) for _ in range(6)]
    texts = []
    for _ in range(90):
        kind = rng.random()
        if texts and kind < 0.25:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(1, 4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("ab é")
            texts.append("".join(t))
        elif kind < 0.8:
            texts.append(prose(rng.randint(0, 30)) + " ".join(rng.sample(passages, 2)) + prose(rng.randint(0, 30)))
        else:
            texts.append(rng.choice(["", "a" * rng.randint(40, 300), "ab" * rng.randint(20, 90), prose(60)]))
    return [None, "", "x" * 49, "x" * 50, "x" * 50, *texts]


@pytest.mark.parametrize(("seed", "chunk", "shard"), [(1, 1 << 20, 48 << 20), (2, 200, 3000), (3, 1 << 20, 900)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, chunk, shard):
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    monkeypatch.setattr(sd, "INDEX_BYTES", shard // 3)
    monkeypatch.setattr(sd, "DEALT", chunk)
    monkeypatch.setattr(sd, "CHUNK", chunk)
    rows = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS shard")
    got = {}
    for r in sd.remove_repeats(df).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.spans) == r.n_removed
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert got == brute(rows)


def test_null_ids_repeated_ids_and_no_rows(spark):
    a, b = "".join(map(str, range(60))), "other text " * 9
    df = spark.createDataFrame([(None, a), (4, a), (4, a), (4, b), (7, a), (8, "-" + b)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in sd.remove_repeats(df).collect())
    assert got == [(-1, 0), (4, 0), (4, 0), (4, 0), (7, len(a)), (8, len(b))]
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_stretches_cover_all_windows_once():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    ends = np.array([10, 59, 60, 1000, 1049, 1099, 3000])
    first, last, anchor, gram, content = sd.stretches(data, ends)
    covered = [p for a, b in zip(first, last) for p in range(a, b + 1)]
    begins = [0, *ends[:-1]]
    assert covered == [p for s, e in zip(begins, ends) for p in range(s, e - 49)]
    assert ((anchor >= last) & (anchor + sd.ANCHOR <= first + 50)).all()
    whole = sd.stretches(data[1000:1049], np.array([49]))
    assert len(whole[0]) == 0
    # Long texts are cut between windows only.
    import pyarrow as pa

    text = "".join(map(chr, data[:2500]))
    batch = pa.record_batch([pa.array([text, "ab"])], names=["text"])
    old, sd.CHUNK = sd.CHUNK, 300
    try:
        windows = [p + b[0] for d, e, _, b in sd._pieces(batch) for p in range(max(0, len(d) - 49)) if len(e) == 1]
    finally:
        sd.CHUNK = old
    assert windows == list(range(2451))


def test_index_alone_finds_what_brute_force_finds():
    """Whole texts in run-length indexes, without anchors: one index, and several that all texts are streamed through."""
    rows = [(i, t) for i, t in enumerate(corpus(5)) if t]
    want = brute(rows)
    texts = [t.encode() for _, t in rows]
    size, data = np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8)
    docs = np.array([i for i, _ in rows])
    for limit in (None, 3000, 400):
        found = sd.earliest(data, size, docs, limit)
        at = 0
        for (i, _), n in zip(rows, size.tolist(), strict=True):
            covered = np.zeros(n, bool)
            for p in range(max(0, n - 49)):
                if found[at + p] < i:
                    covered[p : p + 50] = True
            at += max(0, n - 49)
            assert covered.sum() == want[i][0][1]


def test_matching_statistics_are_the_longest_matches():
    rng = random.Random(8)
    for alphabet in (b"a", b"ab", "aé\0".encode()):
        some = lambda n, letters=alphabet: bytes(rng.choice(letters) for _ in range(n))
        texts, patterns = [some(rng.randint(1, 40)) for _ in range(9)], [some(rng.randint(1, 60)) for _ in range(5)]
        as_arrays = lambda x: (np.frombuffer(b"".join(x), np.uint8), np.array([len(t) for t in x]))
        index = RunIndex(*as_arrays(texts), np.arange(9), 8)
        assert len(index.char) <= len(index.data)
        for which, place, length, _, found in index.statistics(*as_arrays(patterns)):
            for w, i, n, f in zip(which, place, length.tolist(), found.tolist()):
                rest = patterns[w][i:]
                assert n == max(k for k in range(len(rest) + 1) if any(rest[:k] in t for t in texts))
                assert index.data[f : f + n].tobytes() == rest[:n]


def test_a_repetitive_corpus_has_few_runs():
    base = bytes(np.random.default_rng(3).integers(97, 123, 3000).astype(np.uint8))
    texts = [base] * 40
    index = RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.array([3000] * 40), np.arange(40), 50)
    assert len(index.char) < 3100 and len(index.data) == 40 * 3001


def test_suffixes_are_sorted_without_sorting_places_by_numbers(monkeypatch):
    rng = random.Random(8)
    words = [bytes(rng.choices(b"ab", k=rng.randint(1, 30))) for _ in range(12)]
    texts = [b"".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(150)]
    size = np.array([len(t) for t in texts])
    data, start = joined(np.frombuffer(b"".join(texts), np.uint8), size)
    left = (start + size)[np.repeat(np.arange(len(size)), size + 1)] - np.arange(len(data))
    monkeypatch.setattr(np, "argsort", None)  # it took more than a quarter of the index
    whole = data.tobytes()
    assert suffixes(data, left).tolist() == sorted(range(len(data)), key=lambda i: (whole[i : i + left[i] + 1], i))
    assert not len(suffixes(data[:0], left[:0]))


def test_places_within_equal_numbers_follow_the_finer_ones():
    rng = np.random.default_rng(9)
    coarse, fine, finest = (rng.integers(0, n, 400) for n in (120, 3, 9))
    order = np.argsort(coarse, kind="stable")
    assert (sd._within(order, coarse[order], fine, finest) == np.lexsort((finest, fine, coarse))).all()

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, wavelet
from tessera.llm.tokens import Encoder

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = Encoder()


def plain(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids, np.uint32)


ODD = ["", " ", "a  b", " a", "a ", "x\n y", "x \ny", "a  b", "a\x1c b c", "it's 's", "a b\n\nc  \n d", "<|endoftext|> a b", "a\0b c", "　 q", "a\tb c\r\nd", "x" * 5000, "é è\nç 🙂 🙂"]


@pytest.mark.parametrize("text", ODD)
def test_pieces_encode_like_whole_texts(text):
    assert ENCODER.encode([text])[0] == plain(text).tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t.,'aBcé1٣_-<|>  \x1c\x85🙂")), max_size=40))
def test_pieces_encode_like_whole_texts_at_random(text):
    assert ENCODER.encode([text])[0] == plain(text).tobytes()


MARKED = ["(a, b.) c_d! _x_. 12. \xfc, \xdf; x'. it's, it's' y\xb2! \xf1\xb2 \u0416. \u4e2d. \xd7. \xe9\u0301, a\nb.\nc, \n?! x", "!!", "...", "a.", "x_.", "'s. ', a'!", "a\tb. c"]


@pytest.mark.parametrize("text", MARKED)
def test_pieces_that_end_with_marks_encode_like_whole_texts(text):
    assert Encoder().encode([text, text])[1] == plain(text).tobytes()


def test_known_words_with_marks_behind_them_do_not_go_to_the_library():
    random.seed(4)
    words = ["".join(random.choices("abcdefghij", k=9)) for _ in range(100)]
    marked = " ".join(w + m for m in (".", ",", "!!", ";)") for w in words)
    encoder, sent = Encoder(), []
    encoder.encode(["x " + " ".join(words)])

    class Counting:
        def __getattr__(self, name, of=encoder.tokenizer):
            return lambda given, **options: sent.append(len("".join(given))) or getattr(of, name)(given, **options)

    encoder.tokenizer = Counting()
    assert encoder.encode(["x " + marked])[0] == plain("x " + marked).tobytes()
    assert sum(sent) < 50  # the marks alone


def documents(spark):
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefghij", k=random.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(random.choice([1, 5, 60, 200, 900])))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (1002, rows[3][1]), (None, "no id"), (1003, "z " * 4000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS shard")


def test_packing_holds_every_token_once(spark):
    rows, df = documents(spark)
    got = packing.pack(df, capacity=256).collect()
    by_doc = {}
    for i, (doc, text) in enumerate(rows):
        by_doc.setdefault(doc, []).append(np.append(plain(text), np.uint32(2)))
    assert sum(r.length for r in got) == sum(len(x) for xs in by_doc.values() for x in xs)
    for doc, wanted in by_doc.items():
        mine = sorted((r.start, r.piece, r.length, bytes(r.ids), r.ids_crc32) for r in got if r.doc_id == doc)
        if len(wanted) == 1:
            assert b"".join(m[3] for m in mine) == wanted[0].tobytes()
            assert [m[1] for m in mine] == list(range(len(mine)))
            assert all(m[2] == 256 for m in mine[1:])
        assert all(zlib.crc32(m[3]) == m[4] and len(m[3]) == 4 * m[2] for m in mine)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.02 * np.ceil(sum(r.length for r in got) / 256) + 1


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=12))
def test_local_search_keeps_the_items_and_never_adds_bins(histogram):
    start = packing.best_fit(histogram, 50)
    end = packing.improve(start, 50)
    for groups in (start, end):
        held = {}
        for items, n in groups:
            assert sum(items) <= 50
            for x in items:
                held[x] = held.get(x, 0) + n
        assert held == histogram
    assert sum(n for _, n in end) <= sum(n for _, n in start)
    square = lambda gs: sum(n * sum(i) ** 2 for i, n in gs)
    assert square(end) >= square(start)


def test_local_search_empties_a_bin():
    # Best fit leaves three bins; one-for-one exchanges make two.
    assert sum(n for _, n in packing.improve([((6, 2), 1), ((5, 3), 1), ((4,), 1)], 10)) == 2


@pytest.mark.parametrize("ids", [[], [7], [7] * 2000, list(range(3000)), [0, 50256, 3] * 700])
def test_wavelet_matrix(ids):
    ids = np.array(ids, np.uint32)
    m = wavelet.WaveletMatrix.build(ids)
    assert m.decode().tolist() == ids.tolist()
    for i in range(0, len(ids), 97):
        assert m.access(i) == ids[i]
    for token in {*ids[:3].tolist(), 12345}:
        where = np.flatnonzero(ids == token)
        assert m.count(token) == len(where) and m.locate(token, len(where)) == -1
        assert m.count(token, 3, len(ids) // 2) == int((ids[3 : len(ids) // 2] == token).sum()) if len(ids) > 6 else True
        for k in range(0, len(where), 61):
            assert m.locate(token, k) == where[k]


def test_shards_come_back(spark):
    rows, df = documents(spark)
    path = wavelet.fresh_path(spark, "wm")
    got = wavelet.encode_and_read(df, path, shard_tokens=3000).collect()
    order = sorted(((-1 if d is None else d), t or "") for d, t in rows)
    start, want = 0, []
    for doc, text in order:
        ids = np.append(plain(text), np.uint32(0))
        want.append((None if doc < 0 else doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got), key=lambda x: x[1]) == want
    assert spark.read.parquet(f"{path}/manifest").count() > 3
    ids, known, lengths, m = wavelet.open_shard(f"{path}/000000-000000.wm")
    assert not known[0] and m.n == lengths.sum() and m.count(0) >= len(ids) and m.locate(0, 0) == lengths[0] - 1
    assert wavelet.encode_and_read(df.limit(0)).count() == 0

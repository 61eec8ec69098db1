"""Rows that share an id but not a text: each links by its own text, and only copies and linked rows go."""

import random
import re

import corpus_pipeline
from tessera.llm import jaccard

from .test_jaccard import brute, corpus


def clashing_rows(seed):
    """Rows of a corpus dealt to few ids, so that most ids have several texts."""
    rng = random.Random(seed)
    rows = [(rng.randrange(70), t) for t in corpus(seed, 150)]
    return rows + rows[:5] + [(9000, "lone words of one id that nobody else has at all"), (2**63 - 1, "x y z")]


def expected(rows):
    # Brute force over rows; a row's place in the order of ids stands for it.
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    found = brute([(at, rows[i][1]) for at, i in enumerate(order)])
    return [(rows[i], found[at][0], found[at][1], at, rows[order[found[at][1]]][0]) for at, i in enumerate(order)]


def test_every_text_of_an_id_links(spark):
    rows = clashing_rows(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(tuple(r) for r in jaccard.classes(df).collect())
    assert got == sorted((i, n, c) for (i, _), n, _, _, c in expected(rows))


def test_pipeline_keeps_different_texts_of_an_id(spark):
    rows = clashing_rows(3)
    df = spark.createDataFrame([(i, t, {"m": i}) for i, t in rows], "doc_id long, text string, extra map<string,long>").repartition(5)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    same = lambda t: re.sub("[ \t-\r]+", " ", t or "").strip().lower()
    kept = [(r.doc_id, same(r.text)) for r in out.collect()]
    classes = {}
    for (i, t), n, c, _, low in expected(rows):
        classes.setdefault(c if n else (i, "empty"), (low, set()))[1].add((i, same(t)))
    assert len(kept) == len(classes)
    assert all(sum((i, t) in members and i == low for i, t in kept) == 1 for low, members in classes.values())


def test_a_clean_text_of_a_shared_id_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(3, a), (5, a + " more"), (5, b), (7, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [(3, a), (5, b)]

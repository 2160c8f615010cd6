import math
import random
import re

import pytest

from spectrail.llm import lexical

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items):
    """Every document's score for every item."""
    own = [(d, words(t)) for d, t in docs]
    n_docs, n_terms = sum(1 for _, w in own if w), sum(len(w) for _, w in own)
    df = {}
    for _, w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, w in own:
            m = 100 - 50 + (50 * len(w) * n_docs) // n_terms if w else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in set(words(text)) if t in w)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:50])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("width", [2, 1024])
def test_equals_brute_force(spark, width):
    rng = random.Random(5)
    vocabulary = ["the", "Of", "café", "CAFÉ", "x1", "ß", "日本", "a-b", "İx", "q_r"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.randrange(1, 50)]) for _ in range(rng.randrange(30)))) for i in range(400)]
    docs += [(500 + i, "the the Of w1 w2") for i in range(120)] + [(700, None), (701, ""), (702, ",;. -"), (None, "w3 w4")]
    items = [(i, " ".join(rng.sample(vocabulary, 6))) for i in range(20)] + [(50, None), (51, ""), (52, "nowhere"), (53, "the")]
    df, asked = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(lexical.search(df, asked, width)) == brute(docs, items)


def test_odd_tables(spark):
    docs = [(1, "alpha beta " * 20_000), (2, "alpha"), (2, "alpha"), (3, "beta")]
    df = spark.createDataFrame([(*r, 7, "x") for r in docs], "doc_id bigint, text string, Q int, SCORE string")
    asked = spark.createDataFrame([(1, "alpha", 5), (1, "beta", 6)], "item_id bigint, text string, rank int")
    found = rows(lexical.search(df, asked))
    assert len({r[3] for r in found if r[2] == 2}) == 1 and [r[:3] for r in found] == [(1, 1, 1), (1, 1, 1), (1, 2, 2), (1, 2, 3), (1, 3, 2)]
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert lexical.search(none, asked).count() == 0
    assert lexical.search(df, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), asked).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    docs = [(i, f"w{i % 7} w{i % 5}") for i in range(60)]
    items = [(i, f"w{i} w{i + 1}") for i in range(7)]
    df, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(lexical, "ITEMS", 3)
    assert rows(lexical.search(df, asked)) == brute(docs, items)


def test_bounds_are_never_below_scores():
    import numpy as np

    block = lexical._Block([[0, 1, 2]], [b"a", b"b", b"c"], {0: 1, 1: 2, 2: 3}, 9, 90, 2)
    f = np.array([400, 300, 200])
    sketch = np.zeros((1, 2))
    np.maximum.at(sketch, (np.zeros(3, int), block.coordinate), f)
    assert (sketch @ block.lookup)[0, 0] >= f @ block.weights[0]

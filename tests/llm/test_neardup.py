import random
import re
from collections import defaultdict

import numpy as np
import pytest

from spectrail.llm import neardup
from spectrail.llm.words import mixed


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = frozenset() if not w else frozenset([tuple(w)] if len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places, shared = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            places[x].append(i)
    for at in places.values():
        for a in range(len(at)):
            for b in range(a):
                shared[at[b], at[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    r = random.Random(seed)
    v = [f"W{i}" for i in range(300)]
    base = [[r.choice(v) for _ in range(r.choice([3, 5, 20, 60, 100]))] for _ in range(12)]
    passage = [r.choice(v) for _ in range(60)]
    rows = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "one two three"), (1006, "é É")]
    for i in range(350):
        kind = r.random()
        if kind < 0.6:
            w = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6])):
                w[r.randrange(len(w))] = r.choice(v)
        elif kind < 0.9:
            w = [r.choice(v) for _ in range(r.randint(2, 12))] + passage + [r.choice(v) for _ in range(r.randint(0, 5))]
        else:
            w = [r.choice(v) for _ in range(r.randint(0, 8))]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(docs).collect()}
    assert got == brute(rows, 4, 80)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    got = sorted(((x.doc_id is None, x.doc_id or 0), x.component_id, x.kept) for x in neardup.near_duplicates(docs).collect())
    assert got == [((False, 3), 3, True), ((False, 5), 3, False), ((False, 5), 3, False), ((True, 0), None, True)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_a_document_of_several_texts_ties_them_together(spark):
    w = [f"w{i}" for i in range(200)]
    a, b = " ".join(w[:100]), " ".join(w[100:])
    near = lambda text: text.replace("w50 ", "x ").replace("w150 ", "y ")
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, " ".join(reversed(w))), (7, a), (7, "one two three four five"), (6, "one two three four five")]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = {(x.doc_id, x.component_id, x.kept) for x in neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (6, 1, False), (7, 1, False)}


def test_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, text), (2, text.replace("w7 ", "x ")), (3, text[: len(text) // 2])]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == got[2][0] == 149_997 and (got[1][1], got[2][1], got[3][1]) == (1, 1, 3)


def test_sketches_fill_and_agree_like_the_sets():
    n, t = 400, 128
    shared = np.arange(300, dtype=np.uint64)
    a, b = np.concatenate([shared, np.arange(1000, 1000 + n - 300, dtype=np.uint64)]), np.concatenate([shared, np.arange(5000, 5000 + n - 300, dtype=np.uint64)])
    rows = np.repeat([0, 1, 2], [n, n, 1])
    out = neardup.sketches(rows, mixed(np.concatenate([a, b, np.array([7], np.uint64)])), 4, t)
    full = 2**64 - 1
    assert (out[:3] != full).all() and (out[3] == full).all()
    assert abs((out[0] == out[1]).mean() - 300 / 500) < 0.15


def test_only_sets_that_are_compared_are_dealt_out(spark):
    ids = spark.range(50).withColumnRenamed("id", "doc_id")
    from pyspark.sql import functions as F

    sets = ids.select("doc_id", F.sequence(F.lit(1), F.lit(20)).cast("array<long>").alias("items"))
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    out = neardup._verified(pairs, sets, sets, 80)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2), (3, 4)]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectrail.llm import substrings


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=30).map(str.encode), min_size=1, max_size=25), st.sampled_from([0, 1, 4, 16]))
def test_deep_shallow_sorts(strings, shallow):
    order, shared = substrings.deep_shallow(strings, 0, shallow)
    ranked = sorted(strings)
    assert [strings[i] for i in order] == ranked and sorted(order) == list(range(len(strings)))
    assert shared == [0] + [substrings.common(a, b) for a, b in zip(ranked, ranked[1:])]


def brute(rows, length):
    count = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] += 1
    out = []
    for i, b in texts:
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                edge[s] += 1
                edge[s + length] -= 1
        covered = edge.cumsum()[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        out.append((i, len(b), int(covered.sum()), int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", [4, 256])
def test_removes_what_brute_force_removes(spark, group):
    r = random.Random(5)
    v = ["ab", "cd", "é", "xyz", "q", "lorem", "ipsum"]
    passage, rows = " ".join(r.choice(v) for _ in range(30)), [(900, None), (901, ""), (902, "short"), (902, "short")]
    for i in range(120):
        w = " ".join(r.choice([*v, str(r.randrange(50))]) for _ in range(r.randint(0, 40)))
        if r.random() < 0.3:
            k = r.randrange(40)
            w = w[:20] + passage[k : k + r.randint(10, 60)] + w[20:]
        if r.random() < 0.1:
            w = "ha " * r.randint(3, 40)
        if r.random() < 0.1:
            w = r.choice(rows)[1]
        rows.append((i, w))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_bytes int")
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.without_repeats(docs, 20, 8, group).collect())
    assert got == brute(rows, 20)


def test_long_text_in_pieces(spark, monkeypatch):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(3000))
    monkeypatch.setattr(substrings, "_PIECE", 1000)
    import pyarrow as pa

    pieces = list(substrings._pieces(pa.array([text]), 400))
    assert [at for *_, at in pieces] == [0, 1000, 2000] and len(pieces[0][2]) == 1399
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[:450] + "x" + text[700:])], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_removed) for x in substrings.without_repeats(docs).collect())
    assert got == [(1, 3000), (1, 3000), (2, 2750)]
    assert substrings.without_repeats(docs.limit(0)).count() == 0

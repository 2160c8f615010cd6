import hashlib
import random
import re
import time

import numpy as np
import pytest

from spectrail.llm import personal

KINDS = ("email", "ip", "card", "phone")
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def good(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    """The contract's base, with its own expressions."""
    return [(k, *m.span()) for k, kind in enumerate(KINDS) for m in re.finditer(PLAIN[k], text or "") if good(kind, m[0])]


def test_patterns_equal_the_plain_expressions():
    rng = random.Random(3)
    for _ in range(30_000):
        text = "".join(rng.choice(["@", ".", "-", " ", "+", "(", ")", "1", "12", "255", "256", "4111111111111111", "a", "b_", "é", "%", "\n", "0", "٣"]) for _ in range(rng.randrange(1, 16)))
        assert personal.patterns(text) == brute(text), text


def test_time_grows_with_the_text():
    for text in ("a" * 10**6, "1" * 10**6, "1." * 500_000, "+1" * 500_000, "a@" * 300_000, "@." * 300_000, "a@b." * 200_000, "1 " * 300_000, "+1 ( " * 200_000):
        began, graph = time.perf_counter(), personal.Graph()
        graph.add(0, text, personal.patterns(text))
        graph.arrays()
        assert time.perf_counter() - began < 20, text[:10]


def test_held_out_documents():
    """Made documents that the fit has not seen: spans that patterns miss are found, numbers that are none are left alone."""
    field, (graph, truth) = personal.trained(), personal.labelled(300, 1234)
    node, _ = field.beliefs(graph.arrays(), len(truth))
    sure = np.where(node.max(axis=1) >= personal.LEAST, node.argmax(axis=1), 0)
    assert (sure == truth).mean() > 0.98
    assert (truth[sure > 0] == sure[sure > 0]).mean() > 0.995


def spans(text):
    field, graph = personal.trained(), personal.Graph()
    base = personal.patterns(text)
    graph.add(0, text, base)
    node, _ = field.beliefs(graph.arrays(), len(graph.spans))
    return [(KINDS[k], text[s:e]) for k, s, e in personal.added(graph, node, {0: base}).get(0, [])]


def test_repeated_numbers_agree_across_a_document():
    assert spans("Call +1 (918) 555-3922 today, they said. Much later in the text 918-555-3922 again.") == [("phone", "918-555-3922")]
    assert spans("The sum was 918-555-3922 in all. Nothing else stands here.") != [("card", "918-555-3922")]
    assert spans('token = "740d10cfb38a379bfbce847f43f32482d573dc8b" and 12.50 of 2024-01-02, page 77, 1 | 2 | 3') == []
    assert spans("") == []


def test_message_passing_is_exact_on_chains():
    """On a tree, beliefs are the marginals that all labelings give."""
    rng = np.random.default_rng(0)
    field = personal.Field(rng.normal(size=(personal.ROOM, 5)), rng.normal(size=(3, 5, 5)))
    graph = (np.arange(3), np.array([1, 2, 3]), np.array([[0, 1, 0], [1, 2, 1]]))
    node, joint = field.beliefs(graph, 3, 60)
    u, p = field.unary, field.pair
    every = np.exp(u[1][:, None, None] + u[2][None, :, None] + u[3][None, None, :] + p[0][:, :, None] + p[1][None, :, :])
    every /= every.sum()
    assert np.allclose(node[1], every.sum(axis=(0, 2)), atol=1e-6) and np.allclose(joint[0], every.sum(axis=2), atol=1e-6)


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (2, ""), (3, "x@y.zz"), (3, "x@y.zz"), (None, "é" * 300_000 + " +1 (918) 555-3922")]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, 5, "b") for r in rows], "doc_id bigint, text string, Added int, `odd name` string")
    found = personal.find(df)
    assert found.columns == ["doc_id", "text", "Added", "odd name", "base", "added_"]
    for r in found.collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == [(KINDS[k], s, e) for k, s, e in brute(r["text"])] and r["added_"] == []


def test_the_table(spark):
    found = personal.op12_personal(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(found) == len(texts)
    for r in found:
        base = [f"{KINDS[k]}:{s}:{e}" for k, s, e in brute(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b.startswith(k + ":") for b in base) for k in KINDS]
        own = [s for s in r["spans"].split(",") if s]
        assert set(base) <= set(own) and own == sorted(own, key=lambda s: (KINDS.index(s.split(":")[0]), int(s.split(":")[1])))

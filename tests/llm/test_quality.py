import re
from collections import Counter

import pytest

from spectrail.llm import quality

TEXTS = ["", None, " \n", "a", "a\na\n a\nb\n\na", "a b c a b c a", "\n\nx\nx", "é#é <>|", "x\ty z\x0bx y z", "%%% ### a", "w " * 5000, "a b a b a", "\nq\n\n q\nq"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count, covered = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2)), set()
    for i in range(len(words) - 2):
        if count[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        counts = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and r.kept == (not r.base_failed)
    assert quality.quality(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("k,n,level", [(0, 100, 0.05), (3, 200, 0.01), (10, 10, 0.05), (0, 0, 0.05)])
def test_bound_is_exact(k, n, level):
    from math import comb

    p = quality.upper_bound(k, n, level)
    if k >= n:
        assert p == 1
    else:
        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - level) < 1e-6


def test_thresholds_spare_good_texts(spark):
    good = [(i, "".join(f"w{j} " for j in range(i % 50, i % 50 + 80)), "en" if i % 2 else "de", 1) for i in range(3000)]
    bad = [(3000 + i, "".join(f"w{j}### " for j in range(80)), "en" if i % 2 else "de", 0) for i in range(300)]
    docs = spark.createDataFrame([r[:3] for r in good + bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in good + bad], "doc_id long, quality int")
    measured = quality.signals(docs)
    cutoffs = quality.thresholds(measured, labels).collect()
    assert {(r.stratum, r.rule) for r in cutoffs} >= {("en", "symbols"), ("de", "symbols")}
    assert all(r.bound <= 0.02 for r in cutoffs)
    kept = {r.doc_id: r.kept for r in quality.quality(docs, labels).collect()}
    assert all(kept[i] for i in range(3000)) and not any(kept[3000 + i] for i in range(300))


def test_small_strata_are_pooled_and_noise_certifies_nothing(spark):
    texts = lambda n, sign: " ".join(f"w{n % 37}x{j}{sign}" for j in range(70))
    rows = [(i, texts(i, ""), f"l{i % 4}", 1) for i in range(400)] + [(400 + i, texts(i, "|"), f"l{i % 4}", 0) for i in range(60)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] * 2, "doc_id long, quality int")
    cutoffs = quality.thresholds(quality.signals(docs), labels).collect()
    assert {r.stratum for r in cutoffs} == {"l0", "l1", "l2", "l3"} and len({(r.bound, r.n_good) for r in cutoffs}) == 1
    assert all(r.n_good >= 149 and r.bound <= 0.02 for r in cutoffs)
    noise = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(rows)], "doc_id long, quality int")
    assert quality.thresholds(quality.signals(docs), noise).count() == 0


def test_certified_set_is_the_longest_that_brute_force_allows():
    from math import comb

    import pandas as pd

    rules, cutoffs, n = ["symbols", "repeats", "symbols"], [40, 30, 20], 300
    lost = [1, 2, 5, n - 8]
    rows = [("g", rules, cutoffs, 0, 1, k, x) for k, x in enumerate(lost)] + [("g", rules, cutoffs, 1, 0, k, 10) for k in range(3)] + [("g", rules, cutoffs, 1, 1, 3, 100)]
    frame = pd.DataFrame(rows, columns=["grp", "rules", "cutoffs", "half", "good", "place", "n"])
    for risk in (0.01, 0.03, 0.06):
        tail = lambda k: sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))  # noqa: B023, E731
        length = next((k for k in range(3) if tail(sum(lost[: k + 1])) > 0.05), 3)
        got = quality._certified(risk, 0.05)(frame)
        assert dict(zip(got.rule, got.cutoff)) == {r: min(c for s, c in zip(rules[:length], cutoffs) if s == r) for r in set(rules[:length])}


def test_the_verdict_is_more_than_the_base(spark):
    """On the driver's table: cutoffs exist, bad texts go, and labels that were not used to certify keep their good texts."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.quality(docs, labels).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    bad, good = [r.kept for r in got if r.quality == 0], [r.kept for r in got if r.quality == 1]
    assert bad and sum(bad) < 0.4 * len(bad) and sum(good) >= 0.97 * len(good)

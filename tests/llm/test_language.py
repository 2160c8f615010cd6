import random

import pytest

from spectrail.llm import language

LETTERS = {"aa": "abcdefg", "zz": "tuvwxyz", "éé": "àéèùçôî"}


def _text(lang, r, n):
    return " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    rows = [(i, _text(k, r, r.choice([5, 60, 300])), k, "clash") for i, k in enumerate(r.choice(list(LETTERS)) for _ in range(400))]
    rows += [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, "12 34 !?", None, "x"), (903, "b " * 20_000, None, "x"), (0, rows[0][1], rows[0][2], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_held_out_accuracy(docs):
    known = docs.withColumn("held_out", language.held_out())
    model = language.train(known.where("not held_out"), steps=250)
    rows = language.identify(known, model, columns=("doc_id", "lang", "held_out")).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(tested) > 50 and sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.97
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "aa"
    # neither the label nor another column is an input
    other = language.identify(known.withColumn("lang", known.source), model, columns=("doc_id",)).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in other) == sorted((r.doc_id, r.lang_pred, r.score) for r in rows)


def test_without_labels_or_rows(docs):
    assert language.train(docs.where("lang = 'none'")) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.limit(0), None).count() == 0
    with pytest.raises(ValueError):
        language.identify(docs.withColumnRenamed("source", "score"), None, columns=("doc_id", "score"))

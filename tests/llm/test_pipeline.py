import corpus_pipeline
from spectrail.llm.tables import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near duplicates", "secrets", "mixture", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, made = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF))
        made.append(docs)
    assert all(d.columns == columns for d in made[:-1])
    language, near, secrets, mixture, packed = made
    clean = spark.read.parquet(f"{SF}/documents.parquet").where("text rlike '[a-z]'")
    assert clean.join(language, "doc_id", "left_anti").count() <= 0.005 * clean.count()
    assert near.count() == near.select("doc_id").distinct().count() <= language.count()
    assert secrets.count() == near.count()
    assert secrets.where("text rlike 'AKIA[0-9A-Z]{16}|token = .[0-9a-f]{40}'").isEmpty()
    words = {r.source: r.n for r in mixture.selectExpr("source", "regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+') AS w").groupBy("source").agg({"w": "sum"}).withColumnRenamed("sum(w)", "n").collect()}
    from spectrail.llm import mixing

    targets = {r.source: int(r.target) for r in mixing.mix(secrets).collect()}
    assert words == {k: v for k, v in targets.items() if v}
    assert mixture.groupBy("doc_id").count().where("count > 2").isEmpty()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()


def test_part_ends_behind_its_last_word(spark):
    docs = spark.createDataFrame([(i, f" a{i}\tb  c\nd ", "en", "s" if i else "t", 12) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.mixed_sources(spark, docs, "").collect()
    assert all(f" a{r.doc_id}\tb  c\nd ".startswith(r.text) and r.n_chars == len(r.text) for r in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, ""))
    assert docs.count() == 0


def test_odd_rows_and_clashing_names(spark):
    extra = ["score", "lang_pred", "kept_id", "suspect", "path", "size", "taken", "whole", "key_id", "component_id", "_text", "c1"]
    long_ = " ".join(f"word{i} and some more of it" for i in range(30_000))
    texts = [None, "", " \n", "123 456", "one plain sentence of a few words", "one plain sentence of a few words", "an other text, with password = hunter2Xq9!zz in it", long_]
    rows = [(i, t, None if i == 4 else "en", None if i % 2 else "s", None, *["x"] * len(extra)) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "a text without any id at all", None, None, None, *["y"] * len(extra))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in extra)
    docs = spark.createDataFrame(rows, schema)
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, ""))
        left.append([r.asDict() for r in docs.collect()])
        assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
    language, near, clean, mixed = left
    ids = lambda rows: sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in rows)
    assert ids(language) == [-1, 4, 5, 6, 6, 7] and ids(near) == ids(clean) == [-1, 4, 6, 6, 7]
    assert all(r["score"] == ("y" if r["doc_id"] is None else "x") for r in mixed)
    assert not any("hunter2" in r["text"] for r in clean) and all(r["n_chars"] == len(r["text"]) for r in clean + mixed)
    assert saved(corpus_pipeline.STAGES[-1][1](spark, docs, "")).count() >= len(mixed)


STRANGE = {
    "it": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Il governo ha annunciato oggi nuove misure.",
    "ru": "Правительство объявило сегодня о новых мерах поддержки семей и предприятий страны, которые вступят в силу в январе.",
    "tr": "Hükümet bugün ailelere ve işletmelere destek olmak için yeni önlemler açıkladı ve bu önlemler ocak ayında yürürlüğe girecek.",
    "ja": "政府は本日、家計と企業を支援するための新たな措置を発表した。この措置は一月に施行される。",
    "letters": "qzv kwpjx fghhq zzrtw vbnmq plkjh xcvqw rtzpq mnbvx qwzrt yxcvb pqlmz jkhgf wqxzv bnmpl",
}


def test_texts_in_none_of_the_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    strange = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(STRANGE.values())], docs.schema)
    kept = saved(corpus_pipeline.known_language(spark, docs.unionByName(strange), ""))
    assert kept.where("doc_id < 0").count() == 0
    labelled = docs.where("lang IS NOT NULL AND text rlike '[a-z]'")
    assert labelled.join(kept, "doc_id", "left_semi").count() >= 0.995 * labelled.count()


def test_no_label_keeps_what_has_a_letter(spark):
    rows = [(1, "some text", None, "s", 9), (2, None, "en", "s", None), (3, "12", None, "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()] == [1]

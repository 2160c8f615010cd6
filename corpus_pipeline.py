"""A pipeline over ``documents``: language, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and reads it again as the next stage's docs. All stages give an empty table for an
empty one, take null in any column, and keep further columns, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm import language, mixing, neardup, packing, secrets
from spectrail.llm.tables import WORD, fresh, read, saved, with_columns_of
from spectrail.sources.shared import new_path, scratch

#: A text whose best language has a smaller mean chance is no text of one language.
LEAST_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or in none of the languages that the table's labels teach, go.

    The best language's mean chance must be at least ``LEAST_SCORE``. Chances only compare languages, so pairs of letters must
    also be as usual as in that language's labelled texts (``language.Pairs``). Null and empty texts have no letter. Rows that repeat are judged alike. Where no row has a text and a label to learn from,
    all documents with a letter stay.
    """
    model = language.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    found = language.identify(plain, model, text_col=f"c{docs.columns.index('text')}", columns=tuple(plain.columns), familiarity=True)
    known = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.col("familiar") >= 0))
    return known.select(*(F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns, strict=True)))


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles: of each group one document stays, the one with the least id.

    Rows that repeat an id are one document and stay or go together; rows without an id, and texts without a word, stay.
    """
    (name,) = fresh(docs, "kept_id")
    path = new_path(spark)
    with scratch(spark):
        neardup.near_duplicates(docs, k=5, percent=80).where("kept").select(F.col("doc_id").alias(name)).distinct().write.parquet(path)
    return with_columns_of(docs.join(spark.read.parquet(path), docs["doc_id"].eqNullSafe(F.col(name)), "left_semi"), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: values judged as secrets are replaced by a label; n_chars follows the text (null for a null text).

    All rows stay, also those that repeat.
    """
    clean = secrets.redact(docs, secrets.train())
    return with_columns_of(clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)), docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as the mix takes it, the one at a source's cut only in part.

    Words keep the white space before them, so the part ends behind its last word. Texts without a word are not taken. A null
    source is a source; rows alike in id, source and number of words are all taken as often as the one taken most.
    """
    key_id, key_source, key_size, taken, size, whole = fresh(docs, "key_id", "key_source", "key_size", "taken", "size", "whole")
    mixed = mixing.mix(docs).where("taken > 0")
    times = mixed.groupBy(F.col("doc_id").alias(key_id), F.col("source").alias(key_source), F.col("size").alias(key_size)).agg(F.max("taken").alias(taken))
    sized = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)))
    same = F.col("doc_id").eqNullSafe(F.col(key_id)) & F.col("source").eqNullSafe(F.col(key_source)) & (F.col(size) == F.col(key_size))
    joined = sized.join(saved(times), same)
    rest = F.col(taken) % F.col(size)
    copies = F.concat(F.array_repeat(F.lit(True), F.floor(F.col(taken) / F.col(size)).cast("int")), F.array_repeat(F.lit(False), F.when(rest > 0, 1).otherwise(0)))
    rows = joined.withColumn(whole, F.explode(copies))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), rest.cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col(whole), F.col("text")).otherwise(part))
    return with_columns_of(rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all that is left into sequences; a null text is empty, and rows that repeat are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("near duplicates", first_of_near_duplicates),
    ("secrets", without_secrets),
    ("mixture", mixed_sources),
    ("packing", packed_sequences),
]
#: Trained models and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

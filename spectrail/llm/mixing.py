"""Mixing sources to target weights.

Documents get a hash-random place within their source; distributed prefix sums of sizes say where a source's budget ends.
Whole epochs come first, the rest of the budget goes to the first documents of that order, and the document at the cut
gives the words that are still missing, so a source's words are its budget exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm.tables import WORD, bucketed_before, read, saved


def budgets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, epochs: float) -> dict:
    """Source to budget: ``share`` times all words by weight, none above ``epochs`` times its source, the excess dealt again by weight.

    Sources are taken in the order of code points (None last), and ``weights`` repeats along it.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, [] if x[0] is None else [ord(c) for c in x[0]]))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    most = {s: epochs * n for s, n in order}
    left, open_, out = share * sum(n for _, n in order), [s for s, _ in order], {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(most[s])
        left = max(0.0, left - sum(most[s] for s in full))
        open_ = [s for s in open_ if s not in full]
    return out


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row for each row of ``docs``.

    A null text and a text without a word have size 0 and take 0. A null source is a source of its own, the last one.
    Rows that repeat an id share its place in the order only if their size is also the same; then they follow each other.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    The driver holds a row for each source (name, size), which grows with the number of sources and not with that of documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    placed = saved(bucketed_before(rows, ["source"], ["doc_id", "size"], F.col("size"), "before"))
    sizes = [(r["source"], r["n"]) for r in placed.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    targets = budgets(sizes, weights, share, epochs)
    table = spark.createDataFrame([(s, n, targets[s]) for s, n in sizes], "source string, source_size long, target double")
    joined = placed.join(table, placed["source"].eqNullSafe(table["source"]))
    words = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), words - rounds * F.col("source_size") - F.col("before")))
    return joined.select("doc_id", placed["source"], "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Fixed values of xxhash64.
_LONG = 2**64
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _hashed_sql(table: str, column: str, seed: str, out: str) -> str:
    """The rows of ``table`` with ``out``: xxhash64 of the long ``column`` with the seed ``seed``, as 0 .. 2**64 - 1."""
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in _PRIMES)
    m = f"{_LONG}::uhugeint"
    turned = lambda x, n: f"({x} * {2**n}::uhugeint % {m} + {x} // {2 ** (64 - n)}::uhugeint)"
    steps = [
        f"((({column}::hugeint + {_LONG}) % {_LONG})::uhugeint * {p2}) % {m}",
        f"xor(({seed} + {p5} + 8) % {m}, {turned('_x', 31)} * {p1} % {m})",
        f"({turned('_x', 27)} * {p1} + {p4}) % {m}",
        f"xor(_x, _x // {2**33}::uhugeint) * {p2} % {m}",
        f"xor(_x, _x // {2**29}::uhugeint) * {p3} % {m}",
        f"xor(_x, _x // {2**32}::uhugeint)",
    ]
    query = f"SELECT *, {steps[0]} AS _x FROM {table}"
    for step in steps[1:-1]:
        query = f"SELECT * REPLACE ({step} AS _x) FROM ({query})"
    return f"SELECT * EXCLUDE (_x), {steps[-1]} AS {out} FROM ({query})"


def op2_sql() -> str:
    """The same by one running sum for each source, in DuckDB's SQL; the order of hashes is computed there, too."""
    return f"""WITH RECURSIVE sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size FROM documents),
first_hash AS ({_hashed_sql('sized', 'doc_id', '42::uhugeint', 'h')}),
both_hashes AS ({_hashed_sql('(SELECT * RENAME (h AS g) FROM first_hash)', 'size', 'g', 'h')}),
placed AS (SELECT *, ((h // {2**32}::uhugeint)::bigint * greatest(1, (count(*) OVER () + 999) // 1000)) // {2**32} AS bucket, CASE WHEN h >= {2**63} THEN h::hugeint - {2**64} ELSE h::hugeint END AS signed FROM both_hashes),
summed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, signed, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM placed),
sources AS (SELECT source, sum(size)::bigint AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::double AS weight FROM sized GROUP BY source),
rounds AS (SELECT source, source_size, weight, 1.5::double * sum(source_size) OVER () AS amount, 0 AS round, NULL::double AS target FROM sources
  UNION ALL SELECT source, source_size, weight, amount - coalesce(sum(2 * source_size) FILTER (is_full) OVER (), 0), round + 1,
    CASE WHEN is_full THEN 2.0 * source_size WHEN NOT any_full THEN share END
  FROM (SELECT *, share > 2.0 * source_size AS is_full, bool_or(share > 2.0 * source_size) OVER () AS any_full
    FROM (SELECT *, amount * weight / sum(weight) OVER () AS share FROM rounds WHERE target IS NULL))),
targets AS (SELECT source, source_size, target, floor(target)::bigint AS words, CASE WHEN source_size > 0 THEN floor(target)::bigint // source_size ELSE 0 END AS whole FROM rounds WHERE target IS NOT NULL)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, words - whole * source_size - before)) AS taken
FROM summed JOIN targets ON summed.source IS NOT DISTINCT FROM targets.source"""

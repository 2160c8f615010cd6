"""Quality rules with risk-controlled thresholds.

A rule rejects a text whose signal is at or above a cutoff. For each stratum the rules form one sequence of nested rule
sets: the choosing half of the labelled texts orders all cutoffs by the bad texts that each rejects for a good one, and the
sequence takes them in, one after the other. The certifying half then walks along the sequence: the exact binomial
(Clopper-Pearson) upper bound of the share of good texts rejected by the whole set must stay within the risk, and the walk
ends at the first set that fails (fixed-sequence testing), so the level is divided by the strata alone (Bonferroni) and the
risk holds for all rules of a stratum together. Of the certified sets the choosing half picks the one that rejects most bad
texts net of good ones. Strata with too few good certifying texts to certify anything are pooled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm.tables import read, saved, text_batches
from spectrail.llm.words import slices, span_hashes, words

#: Cutoffs are k / STEPS for k from STEPS down to 1.
STEPS = 50
_SIGNALS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_U = np.uint64


def _rules() -> dict[str, Column]:
    """Signals of the rules, from 0 to 1, in the columns of `signals`."""
    per_word = lambda c: F.least(F.lit(1.0), F.coalesce(F.col(c) / F.col("n_words"), F.lit(0.0)))
    length = F.col("word_chars") / F.col("n_words")
    return {
        "symbols": F.when(F.col("n_words") > 0, per_word("n_symbols") / 1.0).otherwise(0.0),
        "dup_lines": F.when(F.col("n_words") > 0, F.least(F.lit(1.0), F.col("n_dup_lines") / 10)).otherwise(0.0),
        "repeats": F.when(F.col("n_words") > 0, per_word("n_repeat_words")).otherwise(0.0),
        "long_words": F.when(F.col("n_words") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (length - 3) / 17))).otherwise(0.0),
    }


def _repeats(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each row, its words in windows of three words found twice or more in the row."""
    if len(hashes) < 3:
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        window = hashes[:-2] * _U(0x9E3779B97F4A7C15) + hashes[1:-1] * _U(0xC2B2AE3D27D4EB4F) + hashes[2:] * _U(0x165667B19E3779F9)
    same = np.flatnonzero(row[:-2] == row[2:])
    order = same[np.lexsort((window[same], row[same]))]
    equal = (row[order][1:] == row[order][:-1]) & (window[order][1:] == window[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    covered = np.zeros(len(hashes), bool)
    at = order[twice]
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return np.bincount(row[covered], minlength=n)


def _dup_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """For each row, lines with a word that are equal to an earlier line."""
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets[1:]]))
    begins = np.concatenate([[0], ends[:-1] + (data[np.minimum(ends[:-1], len(data) - 1)] == 10)]) if len(ends) else ends
    # a row's end that is no line feed is the next row's start
    keep = begins < ends
    begins, ends = begins[keep], ends[keep]
    has = np.searchsorted(starts, begins, "left") < np.searchsorted(starts, ends, "left")
    begins, ends = begins[has], ends[has]
    row = np.searchsorted(offsets, begins, "right") - 1
    hashes = span_hashes(data, begins, ends, lower=False)
    order = np.lexsort((hashes, row))
    again = (row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    return np.bincount(row[order][1:][again], minlength=n)


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts of each whole text. Words are runs of other bytes than ASCII white space; a null text has none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, to, data, offsets in slices(batch.column(2)):
                n = to - first
                starts, ends, row = words(data, offsets)
                inside = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=inside[1:])
                symbol = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_SYMBOL[data], out=symbol[1:])
                chars = np.bincount(row, (inside[ends] - inside[starts]).astype(float), n).astype(np.int64)
                columns = [np.bincount(row, minlength=n), chars, symbol[offsets[1:]] - symbol[offsets[:-1]], _dup_lines(data, offsets, starts, n) if len(data) else np.zeros(n, np.int64), _repeats(span_hashes(data, starts, ends, lower=False), row, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), *(pa.array(c.astype(np.int64)) for c in columns)], [x.split()[0] for x in _SIGNALS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col)).transform(text_batches).mapInArrow(each, _SIGNALS)


def _at_most(k: int, n: int, p: float) -> float:
    """The chance of ``k`` or fewer of ``n``, each with the share ``p``."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(1, k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(n - i + 1) - np.log(i))])
    return float(np.exp(logs + np.arange(k + 1) * math.log(p) + (n - np.arange(k + 1)) * math.log1p(-p)).sum())


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact binomial upper bound: the largest share at which k or fewer of n still have a chance of ``level``."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if _at_most(k, n, p) > level else (low, p)
    return high


def _sequences(names: list[str]):
    """Counts by rule, step and label of the choosing texts of a group to its sequence of cutoffs, and to the place in it
    (from 0) of the first set that rejects a text, by rule and step."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros((len(names), 2, STEPS + 1), np.int64)
        np.add.at(count, (rows["rule"].map(names.index).to_numpy(), rows["good"].to_numpy(), rows["step"].to_numpy()), rows["n"].to_numpy())
        above = count[:, :, ::-1].cumsum(2)[:, :, ::-1]  # texts at or above a step
        goods, bads = np.maximum(1, count[0, 1].sum()), np.maximum(1, count[0, 0].sum())
        worth = above[:, 0] / bads - 5 * above[:, 1] / goods
        found = [(-(above[r, 0, k] + 0.5) / (above[r, 1, k] + 1), -k, r) for r, k in zip(*np.nonzero(worth > 0), strict=True) if k]
        least, sequence = [STEPS + 1] * len(names), []
        for _, k, r in sorted(found):
            if -k < least[r]:
                least[r] = -k
                sequence.append((r, -k))
        at = np.full((len(names), STEPS + 1), len(sequence), np.int32)
        for place, (r, k) in reversed(list(enumerate(sequence))):
            at[r, k:] = place
        out = {"grp": [rows["grp"].iloc[0]], "rules": [[names[r] for r, _ in sequence]], "cutoffs": [[int(k) for _, k in sequence]]}
        return pd.DataFrame(out | {f"at_{x}": [at[r].tolist()] for r, x in enumerate(names)})

    return each


def _certified(risk: float, level: float):
    """How many texts of a group each set of the sequence is the first to reject, by half and label, to the cutoffs of the
    best set for the choosing half, of those whose bound holds for the certifying half."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rules, cutoffs = list(rows["rules"].iloc[0]), list(rows["cutoffs"].iloc[0])
        lost = np.zeros((2, 2, len(rules) + 1), np.int64)
        np.add.at(lost, (rows["half"].to_numpy(), rows["good"].to_numpy(), rows["place"].to_numpy()), rows["n"].to_numpy())
        sums, whole = lost.cumsum(2), np.maximum(1, lost.sum(2))
        n, passed, worth = int(lost[0, 1].sum()), 0, 0.0
        for k in range(len(rules)):
            if not n or _at_most(int(sums[0, 1, k]), n, risk) > level:
                break
            gain = sums[1, 0, k] / whole[1, 0] - 5 * sums[1, 1, k] / whole[1, 1]
            if gain > worth + 1e-12:
                passed, worth = k + 1, gain
        rejected = int(sums[0, 1, passed - 1]) if passed else 0
        best: dict[str, int] = {}
        for rule, cutoff in zip(rules[:passed], cutoffs, strict=False):
            best[rule] = min(cutoff, best.get(rule, cutoff))
        bound = upper_bound(rejected, n, level)
        return pd.DataFrame([(rows["grp"].iloc[0], r, c, bound, n) for r, c in best.items()], columns=["grp", "rule", "cutoff", "bound", "n_good"])

    return each


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff, bound, n_good): certified cutoffs in steps of 1 / ``STEPS``.

    With a chance of 1 - ``level``, all rules together reject at most ``risk`` of the good texts that pass the base, in every
    stratum that stands alone and in the pool of the others; ``bound`` is what is certified for that stratum or pool, from
    ``n_good`` texts. Labelled texts of even crc32 of the id certify, the others choose. Strata without labelled texts get no
    cutoff, nor do labels other than 0 and 1 count; of several labels of an id the least counts. Without labels, or where even
    the pool is too small to certify anything, the table is empty.
    """
    rules = _rules()
    known = labels.where(F.col(quality_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(F.col(quality_col).cast("int")).alias("good"))
    step = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * STEPS).cast("int")
    half = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)).cast("int")
    found = saved(measured.where(~_failed()).join(known, "doc_id").select(F.coalesce("stratum", F.lit("")).alias("stratum"), "good", half.alias("half"), *(step(c).alias(name) for name, c in rules.items())))
    sizes = saved(found.groupBy("stratum").agg(F.count_if((F.col("half") == 0) & (F.col("good") == 1)).alias("n")))
    strata = sizes.count()
    # as many good texts, none of them rejected, as can certify the risk at all
    enough = math.log(level / max(1, strata)) / math.log1p(-risk)
    groups = saved(sizes.select("stratum", F.when(F.col("n") >= enough, F.concat(F.lit("="), "stratum")).otherwise(F.lit("pool")).alias("grp")))
    tests = max(1, groups.select("grp").distinct().count())
    found = found.join(groups, "stratum")
    marks = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("step")) for name in rules])).alias("s")
    counts = found.where("half = 1").select("grp", "good", marks).groupBy("grp", "s.rule", "s.step", "good").agg(F.count(F.lit(1)).alias("n"))
    kinds = "grp string, rules array<string>, cutoffs array<int>, " + ", ".join(f"at_{x} array<int>" for x in rules)
    sequences = saved(counts.groupBy("grp").applyInPandas(_sequences(list(rules)), kinds))
    place = F.least(*(F.element_at(f"at_{x}", F.col(x) + 1) for x in rules))
    lost = found.join(sequences, "grp").groupBy("grp", "rules", "cutoffs", "half", "good", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    certified = lost.groupBy("grp").applyInPandas(_certified(risk, level / tests), "grp string, rule string, cutoff int, bound double, n_good long")
    return groups.join(certified, "grp").select("stratum", "rule", "cutoff", "bound", "n_good")


def judged(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with base_failed, reasons (the rules that reject) and kept."""
    wide = saved(cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")).withColumnRenamed("stratum", "_s"))
    size = wide.count()
    joined = measured.join(F.broadcast(wide) if size <= 10_000 else wide, F.coalesce("stratum", F.lit("")) == F.col("_s"), "left")
    hits = [F.when(F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * STEPS) >= F.try_element_at("cutoffs", F.lit(name)), F.lit(name)) for name, c in _rules().items()]
    out = joined.withColumn("base_failed", _failed()).withColumn("reasons", F.array_compact(F.array(*hits)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("_s", "cutoffs")


def quality(docs: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts, base_failed, reasons and kept for each row of ``docs``.

    Null and empty texts have no words and fail the base. Repeated rows give repeated results; a null stratum counts as one.
    An empty table gives an empty result. Other columns are not read.
    """
    measured = saved(signals(docs, id_col, text_col, stratum_col))
    return judged(measured, thresholds(measured, labels, risk, level))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

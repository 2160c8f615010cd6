"""Ranked lexical search by hashed max-sketches.

One pass over the texts keeps each document's length and its counts of the queries' terms. A document's impacts then fold into
a sketch: term t belongs to coordinate hash(t) % WIDTH, which holds the largest impact of its terms. A query looks up its
terms' coordinates, for all documents of a batch and all queries of a block as one matrix product; since no impact is
above its coordinate, the weighted sum is an upper bound of the score. Documents are then rescored exactly in the order of
falling bounds, until the bound is below the score of the query's last place. Tasks keep their own places, which meet in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectrail.llm.tables import read, text_batches
from spectrail.sources.shared import saved

#: Coordinates of a sketch; places of a query; queries of a block and their terms (an item with more is a block of its own).
WIDTH, PLACES, ITEMS, TERMS = 1_024, 50, 256, 100_000
#: Documents whose bounds are looked up at once.
DOCUMENTS = 2_000
#: Documents scored at once behind the first of a batch's bounds.
STEP = 64
#: Separators as blanks, A-Z as a-z; all bytes above 0x7F belong to terms.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII, with only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


_COUNTS = "doc_id {0}, n bigint, t array<int>, tf array<bigint>"


def term_counts(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, t, tf) of each document: its terms with repeats, and which of the vocabulary's it holds how often."""
    number = {t: i for i, t in enumerate(vocabulary)}
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, times, offsets = [], [], [], [0]
            for text in batch["text"]:
                words = terms(text.as_py())
                own = Counter(number[w] for w in words if w in number)
                sizes.append(len(words))
                found += own.keys()
                times += own.values()
                offsets.append(len(found))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(found, pa.int32())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))], names=["doc_id", "n", "t", "tf"])

    return text_batches(documents.select("doc_id", "text")).mapInArrow(run, _COUNTS.format(kind))


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``DOCUMENTS`` rows, from smaller or larger ones."""
    held, rows = [], 0
    for batch in (b.slice(at, DOCUMENTS) for b in batches for at in range(0, b.num_rows, DOCUMENTS)):
        held.append(batch)
        rows += batch.num_rows
        if rows >= DOCUMENTS:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


class _Block:
    """Queries of a block: their terms' numbers and weights, and the weights' sum on each coordinate."""

    def __init__(self, items: list[list[int]], vocabulary: list[bytes], df: dict[int, int], n_docs: int, n_terms: int, width: int):
        w = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        self.n_docs, self.n_terms, self.size = n_docs, n_terms, len(vocabulary)
        self.coordinate = np.array([xxhash.xxh64_intdigest(t) % width for t in vocabulary], np.int64)
        self.terms = [np.array(t, np.int64) for t in items]
        self.weights = [w[t] for t in self.terms]
        self.lookup = np.zeros((width, len(items)))
        for q, t in enumerate(self.terms):
            np.add.at(self.lookup[:, q], self.coordinate[t], self.weights[q])

    def places(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best documents of one task for each query: query, doc_id, score."""
        best: list[list[tuple[int, bool, int]]] = [[] for _ in self.terms]  # (-score, no id, id), in order
        for batch in _together(batches):
            ids = batch["doc_id"].to_pylist()
            n = np.asarray(batch["n"])
            counts = np.diff(np.asarray(batch["t"].offsets))
            row, t, tf = np.repeat(np.arange(len(n)), counts), np.asarray(batch["t"].flatten()).astype(np.int64), np.asarray(batch["tf"].flatten())
            m = 100 - 50 + (50 * n * self.n_docs) // self.n_terms
            f = impacts(tf, m[row])
            sketch = np.zeros((len(n), len(self.lookup)))
            np.maximum.at(sketch, (row, self.coordinate[t]), f)
            bounds = sketch @ self.lookup
            key = row * self.size + t
            order = np.argsort(key)
            key, f = key[order], f[order]
            for q in range(len(self.terms)):
                self._rescore(q, bounds[:, q], key, f, ids, best)
        rows = [(q, None if none else i, -s) for q, own in enumerate(best) for s, none, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["q", "doc_id", "score"])

    def _rescore(self, q: int, bounds: np.ndarray, key: np.ndarray, f: np.ndarray, ids: list, best: list) -> None:
        """Exact scores in the order of falling bounds until none can reach the query's last place."""
        least = -best[q][-1][0] if len(best[q]) == PLACES else 1
        can = np.flatnonzero(bounds >= least)
        can = can[np.argsort(-bounds[can], kind="stable")]
        for s in range(0, len(can), STEP):
            some = can[s : s + STEP]
            if bounds[some[0]] < (-best[q][-1][0] if len(best[q]) == PLACES else 1):
                return
            want = some[:, None] * self.size + self.terms[q][None, :]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            scores = np.where(key[at] == want, f[at], 0) @ self.weights[q]
            new = [(-int(x), ids[r] is None, ids[r] or 0) for r, x in zip(some.tolist(), scores.tolist(), strict=True) if x > 0]
            best[q] = sorted(best[q] + new)[:PLACES]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries in blocks of at most ``ITEMS`` and about ``TERMS`` terms, read one after the other."""
    block, size = [], 0
    for row in items.toLocalIterator():
        own = sorted(set(terms(row["text"])))
        if block and (len(block) == ITEMS or size + len(own) > TERMS):
            yield block
            block, size = [], 0
        block.append((row["item_id"], own))
        size += len(own)
    if block:
        yield block


def search(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` the ``PLACES`` best documents with a score above 0.

    The score of a document is the sum over the item's different terms of weight times impact, as the contract of op13
    defines them, in whole numbers; equal scores stand in the order of doc_id, null last. Only ``doc_id`` and ``text``, and
    ``item_id`` and ``text``, are read, whatever other columns there are. Null and empty texts have no terms: such documents
    match nothing and such items get no rows. Repeated rows of documents are documents of their own, repeated rows of items
    are queries of their own; without documents or items there are no rows. Texts count whole, whatever their length.

    Items are a stated set of queries: they are taken in blocks whose terms go to all tasks, with one pass over the texts
    for each block.
    """
    spark, out, totals = documents.sparkSession, None, None
    kind = dict(items.dtypes)["item_id"]
    for block in _blocks(items.select("item_id", "text")):
        vocabulary = sorted({t for _, own in block for t in own})
        number = {t: i for i, t in enumerate(vocabulary)}
        counts = saved(term_counts(documents, vocabulary))
        if totals is None:
            totals = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["t"]: r["count"] for r in counts.select(F.explode("t").alias("t")).groupBy("t").count().collect()}  # the block's terms at most
        found = _Block([[number[t] for t in own] for _, own in block], vocabulary, df, totals[0], max(totals[1], 1), width)
        own = text_batches(counts.where(F.size("t") > 0)).mapInArrow(found.places, f"q bigint, doc_id {dict(counts.dtypes)['doc_id']}, score bigint")
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        # places of tasks meet by query and group of tasks first
        own = own.withColumn("_g", F.spark_partition_id() % 64)
        own = own.withColumn("_n", F.row_number().over(Window.partitionBy("q", "_g").orderBy(*order))).where(F.col("_n") <= PLACES)
        own = own.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= PLACES)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"q bigint, item_id {kind}")
        part = own.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")  # ITEMS rows at most
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {dict(documents.dtypes)['doc_id']}, score bigint")
    return out


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for each item of the benchmark."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def op13_sql() -> str:
    """The same by an inverted table of all terms, in DuckDB's SQL."""
    return f"""WITH words AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS nd, cast(sum(n) AS bigint) AS nl FROM sizes),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY doc_id, t),
w AS (SELECT t, cast(floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1)::double)) AS bigint) AS w FROM tfs, totals GROUP BY t, nd),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
scores AS (SELECT item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // nl))))) AS bigint) AS score
  FROM asked JOIN tfs USING (t) JOIN w USING (t) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {PLACES}"""

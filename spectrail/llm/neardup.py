"""Near duplicates by fast similarity sketches, banding and exact verification.

A sketch has T coordinates. In round i each shingle of a set throws one hashed value into one hashed bin; a bin keeps the
least value of the first round that reached it. After T rounds, round T + j sends every shingle to bin j, so no coordinate
stays empty, and 2 T rounds always suffice. Two sketches agree in a coordinate with the chance of the sets' similarity,
with concentration as for independent minima. Bands of R coordinates make buckets.

Candidates are settled without listing pairs of a bucket: each member is compared with the bucket's first member on the
full sets, and links give components. What a bucket leaves open (members of different components that were not compared)
goes, for those documents only, through an exact prefix filter: two sets of the asked similarity share one of the
rarest shingles of both. So large buckets of unlike documents cost no pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm.tables import components, read, saved, text_batches
from spectrail.llm.words import mixed, shingles, slices, span_hashes, words

#: Coordinates, and coordinates in a band: at a similarity of 0.8, a pair shares no band in 5 of 10**8 cases.
COORDINATES, BAND = 128, 4
_U = np.uint64


def sketches(row: np.ndarray, value: np.ndarray, n_rows: int, t: int = COORDINATES) -> np.ndarray:
    """(n_rows, t) coordinates of sets given as rows and hashes; sets without an element keep the largest value everywhere."""
    empty = _U(2**64 - 1)
    out = np.full(n_rows * t, empty, _U)
    base = row.astype(np.int64) * t
    for i in range(2 * t):
        if not len(row):
            break
        with np.errstate(over="ignore"):
            h = mixed(value + _U((i * 0x9E3779B97F4A7C15 + 0x243F6A8885A308D3) % 2**64))
        at = base + (((h >> _U(40)) * _U(t)) >> _U(24)).astype(np.int64) if i < t else base + (i - t)
        # the round comes first: a value of an earlier round is less than any of a later one
        np.minimum.at(out, at, (_U(i) << _U(55)) | ((h * _U(0x2545F4914F6CDD1D)) >> _U(9)))
        if i >= 2:
            full = (out.reshape(n_rows, t) != empty).all(1)
            if full.any():
                keep = ~full[row]
                row, value, base = row[keep], value[keep], base[keep]
    return out.reshape(n_rows, t)


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, set's row, hash) for slices of texts."""
    for first, to, data, offsets in slices(texts):
        starts, ends, row = words(data, offsets)
        yield first, to, *shingles(span_hashes(data, starts, ends), row, to - first, k)


_PRINTS = "doc_id long, n_shingles long, set_lo long, set_hi long, bands array<long>"


def sketch_documents(docs: DataFrame, k: int, t: int = COORDINATES, band: int = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_lo, set_hi, bands): 128 bits that stand for the whole set, and a hash for each band."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, to, row, value in _sets(batch.column(1), k):
                n = to - first
                counts = np.bincount(row, minlength=n)
                lo, hi = np.zeros(n, _U), np.zeros(n, _U)
                with np.errstate(over="ignore"):
                    np.add.at(lo, row, mixed(value + _U(0x1234567)))
                    np.add.at(hi, row, mixed(value ^ _U(0xABCDEF0123456789)))
                    coords = sketches(row, value, n, t).reshape(n, t // band, band)
                    key = np.zeros((n, t // band), _U)
                    for j in range(band):
                        key = mixed(key * _U(0x9E3779B97F4A7C15 | 1) + coords[:, :, j])
                    key = mixed(key + np.arange(t // band, dtype=np.uint64)[None, :])
                has = counts > 0
                flat = pa.array(key[has].reshape(-1).view(np.int64))
                steps = np.concatenate([[0], np.cumsum(np.where(has, t // band, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(counts.astype(np.int64)), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.ListArray.from_arrays(pa.array(steps), flat)], ["doc_id", "n_shingles", "set_lo", "set_hi", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(text_batches).mapInArrow(each, _PRINTS)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, heads, member, text_id, items): the whole set of each text as hashes, ascending. ``docs`` has the first three and text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, to, row, value in _sets(batch.column(1), k):
                n = to - first
                steps = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
                kept = [batch.column(i).slice(first, n) for i in (0, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(steps), pa.array(value.view(np.int64)))], ["doc_id", "heads", "member", "text_id", "items"])

    return docs.select("doc_id", "text", "heads", "member", F.xxhash64("text").alias("text_id")).transform(text_batches).mapInArrow(each, "doc_id long, heads boolean, member boolean, text_id long, items array<long>")


def _verified(pairs: DataFrame, ones: DataFrame, twos: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) of which any two sets are alike: 100 * intersection >= percent * union. ``ones`` has the sets of a, ``twos`` those of b."""
    one, two = twos.select(F.col("doc_id").alias("b"), F.col("items").alias("ib")), ones.select(F.col("doc_id").alias("a"), F.col("items").alias("ia"))
    # only the sets of documents that are compared are dealt out
    two = two.join(saved(pairs.select("a").distinct()), "a", "left_semi")
    both = pairs.join(one, "b").join(two, "a").where(_sized(F.size("ia"), F.size("ib"), percent))
    shared = F.size(F.array_intersect("ia", "ib"))
    return both.where(100 * shared >= percent * (F.size("ia") + F.size("ib") - shared)).select("a", "b")


def _sized(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be alike: the union is no smaller than the larger, the intersection no larger than the smaller."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, t: int = COORDINATES, band: int = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Texts whose sets of distinct ``k``-word shingles have a similarity of ``percent`` or more are linked, whatever their
    number; component_id is the least doc_id that can be reached. Words are runs of other bytes than ASCII white space,
    A-Z count as a-z; a text of fewer words is one shingle. Null and empty texts and those of white space are alone.
    Rows that repeat a doc_id are one document, which is linked through each of its texts. A null doc_id has n_shingles, no component and is kept. An empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = saved(sketch_documents(texts, k, t, band))
    # documents with the same set are one from here on: the least of them
    ids = prints.where("n_shingles > 0 and doc_id is not null")
    same = saved(ids.groupBy("set_lo", "set_hi", "n_shingles").agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("r")).select("set_lo", "set_hi", "n_shingles", "r.doc_id", "r.bands"))
    # buckets of two or more; a bucket's head is its first document
    members = same.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    heads = saved(members.groupBy("bucket").agg(F.min(F.struct("doc_id", "n_shingles")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    inside = saved(members.join(heads, "bucket").select("bucket", "head", "n", "doc_id", "n_shingles"))
    likely = inside.where((F.col("doc_id") != F.col("head.doc_id")) & _sized(F.col("n_shingles"), F.col("head.n_shingles"), percent))
    pairs = saved(likely.select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct())
    # whose sets are needed: of heads, of members that are compared with one, and of buckets that may stay open
    near = pairs.select(F.col("a").alias("doc_id"), F.lit(True).alias("heads"), F.lit(False).alias("member"))
    near = near.union(pairs.select("b", F.lit(False), F.lit(True))).union(inside.where("n > 2").select("doc_id", F.lit(False), F.lit(False)))
    near = near.groupBy("doc_id").agg(F.bool_or("heads").alias("heads"), F.bool_or("member").alias("member"))
    again = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", F.lit(True).alias("again"))
    near = saved(near.join(again, "doc_id", "left").withColumn("again", F.coalesce("again", F.lit(False))))
    if near.isEmpty():
        links = pairs
    else:
        # only rows that share an id can repeat a text, so no others are dealt out to find that
        rows = texts.join(near.where("not again").drop("again"), "doc_id")
        rows = rows.union(texts.join(near.where("again").drop("again"), "doc_id").dropDuplicates(["doc_id", "text"]))
        sets = saved(shingle_sets(rows, k))
        links = saved(_verified(pairs, sets.where("heads"), sets.where("member"), percent))
        links = _open_links(inside, links, sets, percent)
    # a document of several texts ties the documents that stand for them together
    which = F.struct("set_lo", "set_hi", "n_shingles")
    several = ids.groupBy("doc_id").agg(F.min(which).alias("lo"), F.max(which).alias("hi")).where("lo <> hi").select("doc_id")
    tied = ids.join(several, "doc_id", "left_semi").select("doc_id", "set_lo", "set_hi", "n_shingles").join(same.drop("bands").withColumnRenamed("doc_id", "rep"), ["set_lo", "set_hi", "n_shingles"])
    links = links.union(tied.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    groups = components(links)
    reps = same.select("set_lo", "set_hi", "n_shingles", F.col("doc_id").alias("rep"))
    final = reps.join(groups, F.col("rep") == F.col("node"), "left").select("set_lo", "set_hi", "n_shingles", F.coalesce("component", "rep").alias("component"))
    joined = prints.drop("bands").join(final, ["set_lo", "set_hi", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _open_buckets(inside: DataFrame, links: DataFrame) -> DataFrame:
    """Of buckets of three or more that hold several components: (bucket, doc_id, n_shingles, component)."""
    groups = components(links)
    labelled = inside.join(groups, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    labelled = saved(labelled)
    several = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    # as a table, so that the join deals both of its sides and can split a large bucket
    return saved(labelled.join(saved(several), "bucket", "left_semi"))


def _open_links(inside: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``links`` and further ones between components that share a bucket of three or more.

    First each open bucket's smallest set, which has least of its own beside what they share, is compared with the
    members of other components. What then stays open goes through the prefix filter.
    """
    left = _open_buckets(inside.where("n > 2"), links)
    if left.isEmpty():
        return links
    smallest = saved(left.groupBy("bucket").agg(F.min(F.struct("n_shingles", "doc_id", "component")).alias("s")).select("bucket", F.col("s.doc_id").alias("a"), F.col("s.n_shingles").alias("na"), F.col("s.component").alias("ca")))
    # sets of too different sizes need no comparison, nor a way to another task; their buckets stay open
    likely = left.join(smallest, "bucket").where((F.col("component") != F.col("ca")) & _sized(F.col("n_shingles"), F.col("na"), percent))
    pairs = likely.select("a", F.col("doc_id").alias("b")).distinct()
    links = saved(links.union(_verified(saved(pairs), sets, sets, percent)))
    left = _open_buckets(left.drop("component"), links)
    if left.isEmpty():
        return links
    return links.union(_prefix_links(left.select("doc_id", "component").distinct(), sets, percent))


def _prefix_links(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between documents of different components in ``left`` (doc_id, component), by an exact prefix filter.

    Items are ordered from rare to common. Sets as alike as asked share an item among the first n - ceil(p n) + 1 of both,
    and behind the first shared one there is room for as many shared items as they need.
    """
    left = saved(left)
    items = left.join(sets, "doc_id").select(F.explode("items").alias("item"))
    counts = saved(items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    # items of one document come first and match none: only their number matters
    common = left.join(sets, "doc_id").select("doc_id", "text_id", "component", F.size("items").alias("n"), F.explode("items").alias("item")).join(counts, "item")
    ranked = common.groupBy("doc_id", "text_id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("shared"))
    ranked = ranked.withColumn("single", F.col("n") - F.size("shared"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    ranked = ranked.where(prefix > F.col("single")).select("doc_id", "component", "n", "single", F.posexplode(F.slice("shared", F.lit(1), prefix - F.col("single"))).alias("p", "s"))
    tokens = saved(ranked.select("doc_id", "component", "n", (F.col("n") - F.col("single") - F.col("p")).alias("rest"), F.col("s.item").alias("item")))
    both = tokens.groupBy("item").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("item")
    tokens = saved(tokens.join(saved(both), "item", "left_semi"))
    one = tokens.select("item", F.col("doc_id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    two = tokens.select("item", F.col("doc_id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    # 100 s >= p (na + nb - s) for s shared items, of which there are at most as many as the shorter rest
    room = (100 + percent) * F.least("ra", "rb") >= percent * (F.col("na") + F.col("nb"))
    pairs = one.join(two, (one["item"] == two["item"]) & (F.col("ca") < F.col("cb")) & room).select("a", "b").distinct()
    return _verified(saved(pairs), sets, sets, percent)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op4_sql() -> str:
    """The same by counting shared shingles of all pairs, in DuckDB's SQL."""
    return r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sizes AS (SELECT doc_id, count(s) AS n FROM w LEFT JOIN sets USING (doc_id) GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM sizes LEFT JOIN (SELECT a, min(b) AS low FROM reached GROUP BY a) ON a = doc_id"""

"""The prefix trie of conversations.

A turn is known by 128 bits of hashes of its role, text and place, so texts are read once and never move. Rows of at most
``SEGMENT`` turns of a conversation are range-sharded in the trie's order. Inside a shard, padded matrices of turn ids are
sorted by numpy's lexsort; the change of each column against the row above, OR-accumulated along the columns, marks where
nodes start, and reduceat aggregates each depth from the deepest up. Nodes on the path of a shard's first or last row may go
on in the neighbouring shards: their parts are sums, and meet by the XOR of their turns' ids. What a conversation's later
segments hold below a node is added per conversation, so a conversation of any length stays in rows of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectrail.llm.tables import read, text_batches
from spectrail.sources.shared import saved

#: Turns in one row of the matrices; rows of a shard; turns of a conversation that are gathered before places are known; ids in a chunk of members.
SEGMENT, SHARD, PIECE, CHUNK = 64, 16_384, 1_024, 2_048
#: The first turns that a conversation can take from another: fewer than this.
DONATED = 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_TURN = "struct<a:bigint,b:bigint,n:bigint>"
_PIECES = f"conv_id bigint, part int, start bigint, turns array<{_TURN}>"
_KEY = "struct<a:bigint,b:bigint>"
_PARTS = (
    "resolved boolean, shared boolean, open boolean, a bigint, b bigint, depth bigint, conv_id bigint, parent_conv_id bigint, pa bigint, pb bigint, "
    f"n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, last bigint, path array<{_KEY}>, ends_sha256 string, ends array<struct<first:bigint,ids:binary>>"
)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn, as pieces of at most ``PIECE`` turns with their place in this part."""
    held: list[tuple[int, int, int, list]] = []
    conv, at = None, 0
    for batch in batches:
        ids, part = np.asarray(batch["conv_id"]), np.asarray(batch["part"])
        turns = list(zip(np.asarray(batch["a"]).tolist(), np.asarray(batch["b"]).tolist(), np.asarray(batch["n"]).tolist(), strict=True))
        cuts = np.flatnonzero(np.diff(ids)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            if s == e:
                continue
            if ids[s] != conv:
                conv, at = int(ids[s]), 0
            for x in range(s, e, PIECE):
                more = turns[x : min(e, x + PIECE)]
                held.append((conv, int(part[s]), at, [{"a": a, "b": b, "n": n} for a, b, n in more]))
                at += len(more)
        yield _batch(held, _PIECES_ARROW)
        held = []


_TURN_ARROW = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_PIECES_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("turns", pa.list_(_TURN_ARROW))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ordered_turns(conversations: DataFrame, rows_per_part: int = 200_000) -> DataFrame:
    """(conv_id, place, turns): pieces of each conversation's turns in order, ``place`` that of the first, and none longer than ``PIECE``.

    Turns are (a, b, n): two hashes of role and text, and the text's code points; null role or text is empty. The order is
    that of ``turn``, null first; equal turns stand in the order of their hashes. Rows without conv_id belong to none.
    A conversation of any size is split over tasks: ranges are cut by turn, too, and by row among repeated rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ids = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), text, role).alias("b"), F.char_length(text).cast("long").alias("n"), F.monotonically_increasing_id().alias("row")
    )
    parts = max(1, -(-conversations.count() // rows_per_part), int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", F.asc_nulls_first("turn"), "a", "b", "row"]
    dealt = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "a", "b", "n", F.spark_partition_id().alias("part"))
    pieces = saved(dealt.mapInArrow(_pieces, _PIECES))
    before = Window.partitionBy("conv_id").orderBy("part", "start").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("conv_id", F.coalesce(F.sum(F.size("turns")).over(before), F.lit(0)).alias("place"), "turns")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, n) of each turn of the rebuilt conversations; a conversation without turns has one row without place.

    Conversation c starts with the first h = crc32(c) % 6 turns of conversation c - c % 100 (all if it has fewer, none if
    there is none) and goes on with its own turns behind its first h.
    """
    pieces = saved(ordered_turns(conversations).withColumn("base", F.expr("conv_id - conv_id % 100")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % DONATED))
    first = pieces.where(f"conv_id = base AND place < {DONATED}").select("base", "place", F.explode(F.slice(F.transform("turns", lambda t, i: F.struct(i.alias("i"), t.alias("t"))), 1, DONATED)).alias("x"))
    first = first.select("base", (F.col("place") + F.col("x.i")).alias("place"), "x.t").where(f"place < {DONATED}")
    heads = first.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("place", "t"))).alias("head"))  # at most DONATED of each
    joined = pieces.join(heads, "base", "left").withColumn("taken", F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0))))
    own = joined.select("conv_id", "place", "h", "taken", F.posexplode("turns").alias("i", "t")).where("place + i >= h")
    own = own.select("conv_id", F.expr("place + i - h + taken").alias("place"), "t.*")
    given = joined.where("place = 0").select("conv_id", F.explode_outer(F.slice("head", F.lit(1), F.col("taken").cast("int"))).alias("x"))
    return own.unionByName(given.select("conv_id", "x.place", "x.t.*"))


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, seg, more, a, b, turns): rows of at most ``segment`` turns in order; a and b are the XOR of all earlier turns' ids.

    ``more`` tells that a later segment follows. A conversation without turns has one row with none.
    """
    place = F.col("place")
    keyed = turns.select("conv_id", F.floor(F.coalesce(place, F.lit(0)) / segment).cast("long").alias("seg"), F.when(place.isNotNull(), F.struct("place", F.xxhash64("place", "a", "b").alias("a"), F.xxhash64("b", "place", "a").alias("b"), "n")).alias("t"))
    rows = keyed.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = rows.select("conv_id", "seg", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n"].alias("n"))).alias("turns"))
    xor = lambda k: F.aggregate("turns", F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(t[k]))
    own = Window.partitionBy("conv_id").orderBy("seg")  # one row for each segment
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("conv_id", "seg", F.lead("seg").over(own).isNotNull().alias("more"), *[F.coalesce(F.bit_xor(xor(k)).over(before), F.lit(0)).alias(k) for k in "ab"], "turns")


def _matrices(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, a mask of what is there, and the turns' a, b and n as padded matrices."""
    flat, offsets = lists.flatten(), np.asarray(lists.offsets)
    counts = np.diff(offsets)
    there = np.arange(counts.max(initial=0))[None, :] < counts[:, None]
    out = []
    for name in ("a", "b", "n"):
        m = np.zeros(there.shape, np.int64)
        m[there] = np.asarray(flat.field(name))
        out.append(m)
    return counts, there, *out


def _ids(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def shard_nodes(table: pa.Table, segment: int) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard, depth by depth. Resolved ones are whole but for what later segments hold below open ones."""
    if not table.num_rows:
        return
    conv, seg, more, pa_, pb_ = (np.asarray(table[c].combine_chunks()) for c in ("conv_id", "seg", "more", "a", "b"))
    counts, there, a, b, n = _matrices(table["turns"].combine_chunks())
    columns = [m[:, j] for j in reversed(range(there.shape[1])) for m in (b, a, there)]
    order = np.lexsort((conv, *columns, pb_, pa_, seg))
    conv, seg, more, pa_, pb_, counts, there, a, b, n = (x[order] for x in (conv, seg, more, pa_, pb_, counts, there, a, b, n))
    rows, width = there.shape
    change = np.ones((rows, width + 1), bool)
    unlike = lambda x: x[1:] != x[:-1]
    change[1:, 0] = unlike(seg) | unlike(pa_) | unlike(pb_)
    change[1:, 1:] = unlike(a) | unlike(b) | unlike(there)
    np.logical_or.accumulate(change, axis=1, out=change)
    keys = [np.bitwise_xor.accumulate(np.concatenate([p[:, None], m], axis=1), axis=1) for p, m in ((pa_, a), (pb_, b))]
    leaves, saved_, child = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    levels = []
    for j in reversed(range(width + 1)):
        s = np.flatnonzero(change[:, j])
        e = np.append(s[1:], rows)
        real = counts[s] >= j
        shared = (s == 0) | (e == rows)
        virtual = (seg[s] > 0) if j == 0 else np.zeros(len(s), bool)  # the node itself belongs to the segment before
        resolved = ~(shared | virtual) & (j != segment)
        size, least = e - s, np.minimum.reduceat(conv, s)
        children = np.add.reduceat(child, s)
        last = n[s, j - 1] if j else np.zeros(len(s), np.int64)
        own = resolved & real
        leaves[s] += own & (children == 0)
        saved_[s] += np.where(own, (size - 1) * last, 0)
        levels.append((j, s, e, real, shared, virtual, resolved, size, least, children, last, np.add.reduceat(leaves, s), np.add.reduceat(saved_, s)))
        child = np.zeros(rows, np.int64)
        child[s[real & ~shared]] = 1
    levels.reverse()
    above = None
    for level in levels:
        j, s, e, real, shared, virtual, resolved, size, least, children, last, n_leaves, n_saved = level
        known, parent = np.zeros(len(s), bool), least
        if above is not None:
            up = np.searchsorted(above[1], s, "right") - 1
            known, parent = above[6][up], above[8][up]
        ended = (counts == j) & ~more & ((j > 0) | (seg == 0))
        some = np.add.reduceat(ended.astype(np.int64), s) > 0
        path, sha, ends = [None] * len(s), np.full(len(s), EMPTY_SHA, object), [None] * len(s)
        for i in np.flatnonzero(real & some).tolist():
            own = conv[s[i] : e[i]][ended[s[i] : e[i]]]
            if resolved[i]:
                sha[i] = hashlib.sha256(_ids(own)).hexdigest()
            else:
                ends[i] = [{"first": int(own[k]), "ids": _ids(own[k : k + CHUNK])} for k in range(0, len(own), CHUNK)]
        for i in np.flatnonzero(real & ~resolved & ~virtual).tolist():
            r = s[i]
            path[i] = [{"a": x, "b": y} for x, y in zip(*(k[r, int(seg[r] > 0) : j + 1].tolist() for k in keys), strict=True)]
        zero, here = np.where(virtual, 0, 1), np.flatnonzero(real)
        columns = {
            "resolved": resolved, "shared": shared & ~virtual, "open": np.logical_or.reduceat(counts == segment, s), "a": keys[0][s, j], "b": keys[1][s, j], "depth": seg[s] * segment + j,
            "conv_id": (least, virtual), "parent_conv_id": (parent, ~known), "pa": (keys[0][s, max(j - 1, 0)], np.full(len(s), j == 0)), "pb": (keys[1][s, max(j - 1, 0)], np.full(len(s), j == 0)),
            "n_convs": size * zero, "n_children": children, "n_leaves": n_leaves * zero, "saved": n_saved * zero, "last": last, "path": path, "ends_sha256": (sha, ~resolved), "ends": ends,
        }
        yield _record(columns, here)
        above = level


def _record(columns: dict, here: np.ndarray) -> pa.RecordBatch:
    """The columns' rows at the given places; a pair is a column and where it is null."""
    arrays = []
    for field in _NODES_ARROW:
        x = columns[field.name]
        if isinstance(x, tuple):
            arrays.append(pa.array(x[0][here], field.type, mask=x[1][here]))
        elif isinstance(x, list):
            arrays.append(pa.array([x[i] for i in here.tolist()], field.type))
        else:
            arrays.append(pa.array(x[here], field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_NODES_ARROW)


_KEY_ARROW = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_KINDS = {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string(), f"array<{_KEY}>": _KEY_ARROW, "array<struct<first:bigint,ids:binary>>": pa.list_(pa.struct([("first", pa.int64()), ("ids", pa.binary())]))}
_NODES_ARROW = pa.schema([(x.split(" ")[0], _KINDS[x.split(" ")[1]]) for x in _PARTS.split(", ")])


def _nodes(segment: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from shard_nodes(pa.Table.from_batches(held), segment)

    return run


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node that a segment passes, what the conversation's later segments hold below it."""
    for batch in batches:
        seg, p, q, leaves, kept = (np.asarray(batch[c]) for c in ("seg", "a", "b", "later_leaves", "later_saved"))
        counts, there, a, b, _ = _matrices(batch["turns"])
        keys = [np.bitwise_xor.accumulate(np.concatenate([x[:, None], m], axis=1), axis=1) for x, m in ((p, a), (q, b))]
        column = np.arange(there.shape[1] + 1)[None, :]
        good = (column <= counts[:, None]) & (column >= (seg > 0)[:, None])
        times = good.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[0][good], keys[1][good], np.repeat(leaves, times), np.repeat(kept, times))], names=["a", "b", "more_leaves", "more_saved"])


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's chunks, joined by commas, from rows sorted by key and chunk; one chunk is held at a time."""
    key, digest = None, None
    done: list[tuple[int, int, str]] = []
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sha", pa.string())])
    for batch in batches:
        for a, b, chunk in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if (a, b) != key:
                if digest is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256(chunk)
            else:
                digest.update(b"," + chunk)
        yield _batch(done, schema)
        done = []
    if digest is not None:
        yield _batch([(*key, digest.hexdigest())], schema)


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, rows_per_shard: int = SHARD) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (see ``rebuilt``).

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, all but the last long. (conv_id, depth) tells nodes apart.

    Nulls: role and text count as empty, a null turn stands first, rows without conv_id belong to no conversation. Equal
    turns stand in the order of their hashes, repeated rows are turns of their own, and other columns are not read. A
    conversation without turns is a member of the root. Without conversations there are no nodes. Texts of any length count
    whole; turns are told apart by 128 bits of hashes. A node's hash of members is one sequence by definition, so its ids
    pass through one task, as chunks of ``CHUNK`` ids, some at a time.
    """
    rows = saved(segments(rebuilt(conversations.select("conv_id", "turn", "role", "text")), segment))
    shards = max(1, -(-rows.count() // rows_per_shard))
    parts = rows.repartitionByRange(shards, "seg", "a", "b", "turns", "conv_id").mapInArrow(_nodes(segment), _PARTS)
    parts = saved(parts)
    resolved, key = parts.where("resolved"), ["a", "b"]

    # nodes in more than one shard, and those at a segment's end: parts are added up
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    met = parts.where("NOT resolved").groupBy(*key).agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.bool_or("shared").alias("shared"), F.max("last").alias("last"), F.first("path", True).alias("path"), *sums)
    kids = met.where("shared AND depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("kids"))
    met = met.join(kids, key, "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    met = saved(met.withColumns({"own_leaf": (F.col("n_children") == 0).cast("long"), "own_saved": (F.col("n_convs") - 1) * F.col("last")}))
    below = met.select(F.explode("path").alias("k"), "own_leaf", "own_saved").groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.sum("own_leaf").alias("more_leaves"), F.sum("own_saved").alias("more_saved"))

    # what later segments hold, counted with the smallest member of each node
    own = resolved.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("own_leaf"), ((F.col("n_convs") - 1) * F.col("last")).alias("own_saved"))
    deep = own.unionByName(met.select(*own.columns)).where(F.col("depth") > segment)
    deep = deep.groupBy("conv_id", F.floor((F.col("depth") - 1) / segment).cast("long").alias("seg")).agg(F.sum("own_leaf").alias("own_leaf"), F.sum("own_saved").alias("own_saved"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each segment
    later = rows.where("seg > 0 OR more").select("conv_id", "seg").join(deep, ["conv_id", "seg"], "left")
    later = later.select("conv_id", "seg", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(to) for c, to in (("own_leaf", "later_leaves"), ("own_saved", "later_saved"))])
    later = later.where("later_leaves <> 0 OR later_saved <> 0")
    extra = rows.where("more").join(later, ["conv_id", "seg"]).select("seg", *key, "turns", "later_leaves", "later_saved").mapInArrow(_prefixes, "a bigint, b bigint, more_leaves bigint, more_saved bigint")
    gains = saved(below.unionByName(extra).groupBy(*key).agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved")))

    chunks = parts.where("ends IS NOT NULL").select(*key, F.explode("ends").alias("c")).select(*key, "c.*").repartition(*key).sortWithinPartitions(*key, "first")
    hashes = text_batches(chunks).mapInArrow(_hashes, "a bigint, b bigint, sha string")
    whole = {n: F.col(c) + F.coalesce(more, F.lit(0)) for n, c, more in (("n_leaves", "n_leaves", "more_leaves"), ("saved_tokens", "saved", "more_saved"))}
    met = met.join(gains, key, "left").join(hashes, key, "left").withColumns(whole).withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_SHA)))
    met = saved(met.select(*key, "conv_id", "depth", "parent_conv_id", "pa", "pb", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    parents = met.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("met_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    plain = resolved.where("parent_conv_id IS NOT NULL AND NOT open").withColumnRenamed("saved", "saved_tokens").select(*columns)
    rest = resolved.where("parent_conv_id IS NULL OR open").join(parents, ["pa", "pb"], "left").join(gains, key, "left")
    rest = rest.withColumns(whole | {"parent_conv_id": F.coalesce("parent_conv_id", "met_parent")})
    met = met.join(parents, ["pa", "pb"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "met_parent"))
    return plain.unionByName(rest.select(*columns)).unionByName(met.select(*columns))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(read(spark, sf_dir, "conversations"))


def op11_sql() -> str:
    """The same by grouping all prefixes, in DuckDB's SQL; crc32 goes bit by bit."""
    return r"""WITH own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (SELECT conv_id, turns, list_transform(range(8 * strlen(conv_id::varchar)), lambda i: ((ascii(substr(conv_id::varchar, i // 8 + 1, 1)) >> (i % 8)) & 1)::bigint) AS bits FROM own),
taken AS (SELECT conv_id, turns, xor(4294967295, list_reduce([4294967295] || bits, lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1)))) % 6 AS h FROM bits),
rebuilt AS (SELECT c.conv_id, coalesce(d.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns FROM taken c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (SELECT conv_id, d, len(turns) = d AS ends, turns[1:d] AS path FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(any_value(path[d].t)), 0) AS chars,
  sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY path, d),
children AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT path[1:k] AS path, sum((n IS NULL)::int)::bigint AS n_leaves, sum((n_convs - 1) * chars)::bigint AS saved_tokens
  FROM (SELECT path, n, n_convs, chars, unnest(range(d + 1)) AS k FROM nodes LEFT JOIN children USING (path)) GROUP BY 1)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(n, 0) AS n_children, n_leaves, saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN children USING (path) JOIN below USING (path) LEFT JOIN nodes p ON x.d > 0 AND p.path = x.path[1:x.d - 1]"""

"""Exact repeated substrings by sparse suffix sorting in the deep-shallow way.

A repeated string of LENGTH bytes holds, at the same place in each of its copies, the same anchor: the least hash among its
grams of GRAM bytes. Each window of LENGTH bytes belongs to one anchor, so about one position in 150 stands for all windows
around it, and windows can only be equal if their anchors' grams are. Anchors with the same surroundings are one; those
whose surroundings differ meet by gram, where the suffixes that begin at the anchors, and the reversed prefixes that end
there, are sorted: multikey quicksort down to a shallow depth, then a blind trie for each group that is still alike. The
common lengths of neighbours in both orders say which windows are equal to another one. Grams with more than GROUP
different surroundings are not held by one task: their windows meet as hashes, place by place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm.tables import read, saved, text_batches
from spectrail.llm.words import mixed, powers, slices
from spectrail.llm.words import _BYTE as BYTE_VALUES

LENGTH, GRAM, SHALLOW, GROUP = 400, 100, 16, 256
_U = np.uint64
_PLACE = 24  # bits for a place in a slice
_PIECE = 1 << 22  # longer texts are read in pieces, each with the LENGTH - 1 bytes that follow it


# ---- anchors


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, gram's hash, surroundings' hash, anchor's place and first and last window's place for each run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.view(_U), none.view(_U), none, none, none
    sums, down = _sums(data)
    with np.errstate(over="ignore"):
        grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    key = (grams >> _U(_PLACE) << _U(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    wide = length - gram + 1  # grams in a window
    rows = -(-len(key) // wide)
    grid = np.full(rows * wide, 2**64 - 1, _U)
    grid[: len(key)] = key
    grid = grid.reshape(rows, wide)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    windows = len(data) - length + 1
    owner = (np.minimum(ahead[:windows], behind[wide - 1 : wide - 1 + windows]) & _U(2**_PLACE - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), offsets[1:] - offsets[:-1])[:windows]
    inside = np.arange(windows) + length <= offsets[1:][row]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none.view(_U), none.view(_U), none, none, none
    own = owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last, anchor = at[begin], at[np.concatenate([begin[1:], [len(at)]]) - 1], own[begin]
    with np.errstate(over="ignore"):
        around = (sums[last + length] - sums[first]) * down[first]
        around = mixed(around ^ mixed((anchor - first).astype(_U) * _U(1009) + (anchor - last).astype(_U)))
    return row[first], grams[anchor], around, anchor, first, last


_RUNS = "k1 long, k2 long, gram long, around long, place long, lead int, tail int"


def _pieces(texts: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    for first, to, data, offsets in slices(texts):
        if to == first + 1 and len(data) > _PIECE:
            for at in range(0, len(data) - length + 1, _PIECE):
                part = data[at : at + _PIECE + length - 1]
                yield first, to, part, np.array([0, len(part)]), at
        else:
            yield first, to, data, offsets, 0


def _runs(length: int, gram: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets, begin in _pieces(batch.column(2), length):
                row, grams, around, anchor, low, high = anchors_of(data, offsets, length, gram)
                which = pa.array(row + first)
                place = anchor - offsets[row] + begin
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(1).take(which), pa.array(grams.view(np.int64)), pa.array(around.view(np.int64)), pa.array(place), pa.array((anchor - low).astype(np.int32)), pa.array((anchor - high).astype(np.int32))],
                    [x.split()[0] for x in _RUNS.split(", ")],
                )

    return each


# ---- deep-shallow sorting


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # the first difference lies in low .. high - 1
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Strings by the places where they part: an inner node has such a place and a child for each byte there (-1: the end)."""

    __slots__ = ("items", "root", "strings")

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def add(self, item: int) -> None:
        s = self.strings[item]
        if self.root is None:
            self.root = [item]
            return
        # down without looking at what lies between the branching places, to any leaf that may be alike
        node = self.root
        path = []
        while isinstance(node, tuple):
            depth, children = node
            path.append(node)
            byte = s[depth] if depth < len(s) else -1
            node = children.get(byte)
            if node is None:
                node = next(iter(children.values()))
        other = self.strings[node[0]]
        same = common(s, other)
        if same == len(s) == len(other):
            node.append(item)
            return
        # up to where the new string parts
        above = None
        node = self.root
        for inner in path:
            if inner[0] >= same:
                node = inner
                break
            above = inner
            byte = s[inner[0]] if inner[0] < len(s) else -1
            node = inner[1].get(byte)
            if node is None:
                inner[1][byte] = [item]
                return
        mine = s[same] if same < len(s) else -1
        if isinstance(node, tuple) and node[0] == same:
            node[1][mine] = [item]
            return
        theirs = other[same] if same < len(other) else -1
        parted = (same, {theirs: node, mine: [item]})
        if above is None:
            self.root = parted
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = parted

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(item, length it shares with the one before; -1 for the first)."""
        stack: list[tuple[object, int]] = [(self.root, -1)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, list):
                for i, item in enumerate(node):
                    yield item, shared if i == 0 else len(self.strings[item])
            elif node is not None:
                depth, children = node
                keys = sorted(children, reverse=True)
                stack += [(children[k], depth if k != keys[-1] else shared) for k in keys]


def deep_shallow(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The order of strings that share ``known`` bytes, and the length each shares with the one before (0 for the first)."""
    order: list[int] = []
    shared: list[int] = []

    def put(items: Iterator[tuple[int, int]], before: int) -> None:
        for n, (item, same) in enumerate(items):
            order.append(item)
            shared.append(before if n == 0 else same)

    # multikey quicksort on an explicit stack: (items, depth, length shared with what comes before them)
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), known, 0)]
    while stack:
        items, depth, before = stack.pop()
        if len(items) == 1:
            put(iter([(items[0], 0)]), before)
            continue
        if depth >= known + shallow:
            trie = BlindTrie(strings)
            for i in items:
                trie.add(i)
            put(trie.ordered(), before)
            continue
        byte = {i: strings[i][depth] if depth < len(strings[i]) else -1 for i in items}
        pivot = byte[items[len(items) // 2]]
        less, same, more = ([i for i in items if (byte[i] > pivot) - (byte[i] < pivot) == sign] for sign in (-1, 0, 1))
        parts = [(less, depth), (same, depth + 1), (more, depth)]
        parts = [(x, d) for x, d in parts if x]
        if pivot == -1 and same:  # all of them end here: they are equal
            done = [(x, d) for x, d in parts if x is not same]
            head = not less
            put(iter([(i, len(strings[i])) for i in same]), before if head else depth)
            stack += [(x, d, depth) for x, d in done]
            continue
        stack += [(x, d, before if n == 0 else depth) for n, (x, d) in reversed(list(enumerate(parts)))]
    return order, shared


def equal_windows(lefts: list[bytes], rights: list[bytes], length: int, gram: int) -> np.ndarray:
    """For each anchor of a gram, which windows equal one of another anchor: column o is the window that begins o bytes before it.

    ``lefts`` are the bytes before the anchors, reversed, ``rights`` those from the anchors on.
    """
    n, wide = len(lefts), length - gram + 1
    out = np.zeros((n, wide + 1), np.int64)
    matrices = []
    for strings, known in ((lefts, 0), (rights, gram)):
        order, shared = deep_shallow(strings, known)
        matrix = np.zeros((n, n), np.int64)
        running = np.array(shared)
        for i in range(n - 1):
            lcp = np.minimum.accumulate(running[i + 1 :])
            matrix[order[i], order[i + 1 :]] = lcp
            matrix[order[i + 1 :], order[i]] = lcp
        matrices.append(matrix)
    before, behind = matrices
    # the window at o needs o equal bytes before and length - o behind
    low, high = np.maximum(0, length - behind), np.minimum(before, wide - 1)
    np.fill_diagonal(low, wide)
    i, j = np.nonzero(low <= high)
    np.add.at(out, (i, low[i, j]), 1)
    np.add.at(out, (i, high[i, j] + 1), -1)
    return out.cumsum(1)[:, :wide] > 0


_MATCHED = "gram long, around long, low int, high int"


def _ranges(gram: int, arounds: np.ndarray, found: np.ndarray) -> pd.DataFrame:
    """Runs of True in each row, first and last column, as `_MATCHED`."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return pd.DataFrame({"gram": np.full(len(row), gram, np.int64), "around": arounds[row].astype(np.int64), "low": low.astype(np.int32), "high": high.astype(np.int32)})


def matched_ranges(leads: list[int], data: list[bytes], length: int, gram: int) -> list[tuple[int, int, int]]:
    """(index, low, high) for the surroundings of one gram: the windows low .. high of it equal another one's."""
    lefts = [d[:k][::-1] for d, k in zip(data, leads)]
    rights = [d[k:] for d, k in zip(data, leads)]
    if len(data) == 2:  # two are neighbours in any order
        low, high = max(0, length - common(*rights, gram)), min(common(*lefts), length - gram)
        return [(0, low, high), (1, low, high)] if low <= high else []
    found = equal_windows(lefts, rights, length, gram)
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    return list(zip(row.tolist(), low.tolist(), (np.nonzero(edge == -1)[1] - 1).tolist()))


def _matched(length: int, gram: int):
    """Batches of surroundings, ordered by gram, to `_MATCHED`; a gram that goes on in the next batch waits for it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in _MATCHED.split(", ")]
        waiting: list[list] = [[], [], [], []]

        def done(columns: list[list], ends: list[int]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for a, b in zip([0, *ends], ends):
                if b - a > 1:
                    for i, low, high in matched_ranges(columns[2][a:b], columns[3][a:b], length, gram):
                        for column, x in zip(out, (columns[0][a], columns[1][a + i], low, high)):
                            column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

        for batch in batches:
            columns = [w + batch.column(i).to_pylist() for i, w in enumerate(waiting)]
            grams = columns[0]
            ends = [i for i in range(1, len(grams)) if grams[i] != grams[i - 1]]
            rest = ends[-1] if ends else 0
            waiting = [c[rest:] for c in columns]
            if ends:
                yield done(columns, ends)
        if waiting[0]:
            yield done(waiting, [len(waiting[0])])

    return each


# ---- grams with very many surroundings

_HASHES = "gram long, place int, part int, salt long, hashes binary, arounds binary"


def _window_hashes(length: int):
    """Surroundings of a gram to their windows' hashes, packed by place before the anchor."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple[int, int], list] = {}
        parts = max(1, int(rows["n_around"].iloc[0]) // 50_000)
        for lead, tail, data, around in zip(rows["lead"], rows["tail"], rows["data"], rows["around"]):
            raw = np.frombuffer(data, np.uint8)
            sums, down = _sums(raw)
            with np.errstate(over="ignore"):
                found = mixed((sums[length:] - sums[:-length]) * down[: len(raw) - length + 1])
            for place, h in zip(range(lead, tail - 1, -1), found.tolist()):
                got = out.setdefault((place, h % parts), ([], []))
                got[0].append(h)
                got[1].append(around)
        gram, salt = rows["gram"].iloc[0], rows["salt"].iloc[0]
        return pd.DataFrame([(gram, k[0], k[1], salt, np.array(v[0], "<u8").tobytes(), np.array(v[1], "<i8").tobytes()) for k, v in out.items()], columns=[x.split()[0] for x in _HASHES.split(", ")])

    return each


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a gram's windows at one place, those whose hash comes twice, packed as they came."""
    hashes = [np.frombuffer(x, "<u8") for x in rows["hashes"]]
    value, count = np.unique(np.concatenate(hashes), return_counts=True)
    twice = value[count > 1]
    out = []
    for gram, place, salt, h, arounds in zip(rows["gram"], rows["place"], rows["salt"], hashes, rows["arounds"]):
        hit = np.frombuffer(arounds, "<i8")[np.isin(h, twice)]
        if len(hit):
            out.append((gram, place, salt, hit.tobytes()))
    return pd.DataFrame(out, columns=["gram", "place", "salt", "arounds"])


def _unpacked(length: int, gram: int):
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, np.ndarray] = {}
        for place, arounds in zip(rows["place"], rows["arounds"]):
            for a in np.frombuffer(arounds, "<i8").tolist():
                found.setdefault(a, np.zeros(length - gram + 1, bool))[place] = True
        return _ranges(rows["gram"].iloc[0], np.array(list(found), np.int64), np.stack(list(found.values())))

    return each


# ---- the whole


def _surroundings(length: int):
    """Rows (text, runs) to the bytes of each run's windows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "around", "n_around", "lead", "tail", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text, runs in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode()
                for r in runs.as_py():
                    row = (r["gram"], r["around"], r["n_around"], r["lead"], r["tail"], raw[r["place"] - r["lead"] : r["place"] - r["tail"] + length])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return each


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text, and the number of its maximal removed runs."""
    parts, at, runs = [], 0, 0
    reach = -1
    for low, high in sorted(spans):
        if low > reach:
            runs += 1
            parts.append(text[at:low])
        reach = max(reach, high)
        at = reach
    parts.append(text[at:])
    return b"".join(parts), runs


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` as (k1, k2, doc_id, text), and (k1, k2, spans): the bytes of each text that a repeated string covers, as [from, to).

    Rows are known by 128 bits of id and text, so rows that repeat an id are documents of their own.
    """
    known = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.xxhash64(F.lit("second"), F.col(text_col), F.col(id_col)).alias("k2"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    long_ = known.where(F.octet_length("text") >= length)
    runs = saved(long_.select("k1", "k2", "text").transform(text_batches).mapInArrow(_runs(length, gram), _RUNS))
    often = saved(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    runs = saved(runs.join(often, "gram"))
    each = saved(runs.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place", "lead", "tail")).alias("r")))
    groups = saved(each.groupBy("gram").agg(F.count(F.lit(1)).alias("n_around")).where("n_around > 1"))
    apart = each.join(groups, "gram")
    wanted = apart.groupBy("r.k1", "r.k2").agg(F.collect_list(F.struct("gram", "around", "n_around", "r.place", "r.lead", "r.tail")).alias("runs"))
    data = long_.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text", "runs")
    data = saved(data.transform(text_batches).mapInArrow(_surroundings(length), "gram long, around long, n_around long, lead int, tail int, data binary"))
    few = data.where(F.col("n_around") <= group).select("gram", "around", "lead", "data")
    matched = few.repartition("gram").sortWithinPartitions("gram").transform(text_batches).mapInArrow(_matched(length, gram), _MATCHED)
    salted = data.where(F.col("n_around") > group).withColumn("salt", F.pmod("around", F.ceil(F.col("n_around") / group)))
    hashed = salted.groupBy("gram", "salt").applyInPandas(_window_hashes(length), _HASHES)
    again = hashed.groupBy("gram", "place", "part").applyInPandas(_repeated, "gram long, place int, salt long, arounds binary")
    many = again.groupBy("gram", "salt").applyInPandas(_unpacked(length, gram), _MATCHED)
    whole = each.where("n > 1").select("gram", "around", F.col("r.tail").alias("low"), F.col("r.lead").alias("high"))
    ranges = saved(whole.union(matched).union(many))
    spans = runs.join(ranges, ["gram", "around"])
    spans = spans.select("k1", "k2", F.struct((F.col("place") - F.col("high")).alias("low"), (F.col("place") - F.col("low") + length).alias("high")).alias("span"))
    return known, spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), a row for each row of ``docs``.

    Bytes of whole UTF-8 texts go where they lie in a string of ``length`` bytes that also starts elsewhere, in the same
    document or another one; strings are judged on the input. Null texts are empty. Texts shorter than ``length`` stay whole.
    ``kept`` is what is left, as bytes. An empty table gives an empty result; other columns are not read.
    """
    known, spans = repeated_spans(docs, length, gram, group, id_col, text_col)
    names = [x.split()[0] for x in _KEPT.split(", ")] + ["kept"] * with_bytes

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                kept, n = _cut(raw, [(x["low"], x["high"]) for x in found.as_py() or []])
                for column, x in zip(out, (doc, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names)

    joined = known.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.transform(text_batches).mapInArrow(each, _KEPT + ", kept binary" * with_bytes)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"))


def op8_sql() -> str:
    """The same by grouping all windows of 400 bytes, in DuckDB's SQL."""
    return r"""WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, p, md5_number(b[p:p + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS p FROM bytes)),
again AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
marked AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -400) > 400 AS opens FROM starts SEMI JOIN again USING (h)),
numbered AS (SELECT doc_id, p, sum(opens::int) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
spans AS (SELECT doc_id, min(p) AS s, max(p) + 400 AS e FROM numbered GROUP BY doc_id, span),
cut AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS f FROM spans),
left_over AS (SELECT doc_id, sum(e - s)::bigint AS n_removed, count(*) AS n_spans, max(e) AS f, string_agg(hex(b[f:s - 1]), '' ORDER BY s) AS x FROM cut JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::bigint AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(x, '') || hex(b[coalesce(f, 1):]))) AS kept_sha256 FROM bytes LEFT JOIN left_over USING (doc_id)"""

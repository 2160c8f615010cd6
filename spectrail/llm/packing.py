"""Best-fit packing of tokenized documents by matching large items first.

Documents longer than a sequence are cut; what is left of each is an item of 1 .. capacity tokens. Items of one length are
alike, so the packing is worked out on counts by length (at most ``capacity`` of them, whatever the input), and each item
finds its place by its rank among the items of its length. Ranks come from distributed prefix sums.
"""

from __future__ import annotations

import os
import string
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm.tables import bucketed_before, read, saved, text_batches
from spectrail.llm.words import slices, span_hashes, words

CAPACITY = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker keeps for good, the first ones that it meets, among them the frequent ones, and how many more
#: it keeps until it drops those.
_KEPT, _RECENT = 250_000, 150_000
_encoders: dict = {}
_MARK = np.zeros(256, bool)
_MARK[list(string.punctuation.encode())] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list((string.ascii_letters + string.digits).encode())] = True
_U = np.uint64


class Ids:
    """Token ids by 64-bit hash: an open table of slots over entries in the order in which they came, and one pool of ids."""

    def __init__(self):
        self.size = 0
        self.hashes, self.stops, self.pool = np.zeros(1 << 12, _U), np.zeros((1 << 12) + 1, np.int64), np.zeros(1 << 14, "<u4")
        self._slots(13)

    def _slots(self, bits: int) -> None:
        self.bits, self.entry = bits, np.full(1 << bits, -1, np.int32)
        self._place(np.arange(self.size))

    def _place(self, entries: np.ndarray) -> None:
        slot = (self.hashes[entries] >> _U(64 - self.bits)).astype(np.int64)
        while len(entries):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = entries[free]  # of several for one slot the last one stays
            lost = self.entry[slot] != entries
            entries, slot = entries[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        rest, slot = np.arange(len(hashes)), (hashes >> _U(64 - self.bits)).astype(np.int64)
        while len(rest):
            entry = self.entry[slot]
            hit = (entry >= 0) & (self.hashes[entry] == hashes[rest])
            out[rest[hit]] = entry[hit]
            on = (entry >= 0) & ~hit
            rest, slot = rest[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Distinct hashes that are not here yet, how many ids each has, and all their ids."""
        to, used = self.size + len(hashes), self.stops[self.size]
        room = lambda x, n: np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)]) if n > len(x) else x
        self.hashes, self.stops, self.pool = room(self.hashes, to), room(self.stops, to + 1), room(self.pool, int(used) + len(ids))
        self.hashes[self.size : to], self.pool[used : used + len(ids)] = hashes, ids
        self.stops[self.size + 1 : to + 1] = used + np.cumsum(counts)
        first, self.size = self.size, to
        if 2 * to > 1 << self.bits:
            self._slots((2 * to).bit_length())
        else:
            self._place(np.arange(first, to))

    def shrink(self, keep: int) -> None:
        """Only the first ``keep`` entries stay."""
        self.size = min(self.size, keep)
        self._slots(self.bits)


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of many texts at once, for a tokenizer that drops white space and lowers A-Z.

    Words between white space are tokenized alone, and so is ASCII punctuation behind a letter or digit at a word's end; both
    are looked up by hash, and only what is new goes to the tokenizer. Texts that hold an added token go there whole.
    """

    def __init__(self, tokenizer: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(_tokenizer_path(tokenizer))
        self.added = [x.content for x in self.inner.get_added_tokens_decoder().values()]
        self.known = Ids()

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry in ``known`` of each span of bytes."""
        if self.known.size > _KEPT + _RECENT:
            self.known.shrink(_KEPT)
        hashes = span_hashes(data, starts, ends)
        out = self.known.find(hashes)
        new = np.flatnonzero(out < 0)
        if len(new):
            value, at, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            order = np.argsort(at)  # as they come in the texts, so that the first ones are kept
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            some = [data[starts[i] : ends[i]].tobytes().decode() for i in new[at[order]]]
            found = [e.ids for e in self.inner.encode_batch_fast(some, add_special_tokens=False)]
            out[new] = self.known.size + rank[back]
            self.known.add(value[order], np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], "<u4"))
        return out

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of a slice of texts, ``end_id`` behind each row's, and where each row's begin."""
        starts, ends, row = words(data, offsets)
        n, rows = len(starts), len(offsets) - 1
        if not n:
            return np.full(rows, end_id, "<u4"), np.arange(rows + 1)
        # a word's end without the punctuation there, if a letter or a digit stands before it
        last = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[ends - 1]
        lead = data[np.maximum(last - 1, 0)]
        # letters of two bytes, without the signs for times and division, and without the capital I with a dot, whose small form ends in a mark
        latin = (data[last] >= 0x80) & (lead >= 0xC3) & (lead <= 0xC5) & ((lead != 0xC3) | ((data[last] != 0x97) & (data[last] != 0xB7))) & ((lead != 0xC4) | (data[last] != 0xB0))
        stem = np.where((last >= starts) & (_PLAIN[data[last]] | latin), last + 1, ends)
        tails = np.flatnonzero(stem < ends)
        entry = self._entries(data, np.concatenate([starts, stem[tails]]), np.concatenate([stem, ends[tails]]))
        units = np.full(2 * n, -1, np.int64)
        units[::2], units[2 * tails + 1] = entry[:n], entry[n:]
        unit_row = np.repeat(row, 2)[units >= 0]
        units = units[units >= 0]
        first, count = self.known.stops[units], self.known.stops[units + 1] - self.known.stops[units]
        at = np.cumsum(count) - count
        total = int(count.sum())
        ids = self.known.pool[np.repeat(first - at, count) + np.arange(total)]
        size = np.bincount(unit_row, count, rows).astype(np.int64) + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(total + rows, "<u4")
        inner = np.ones(len(out), bool)
        inner[begin[1:] - 1] = False
        out[inner], out[~inner] = ids, end_id
        return out, begin


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the ids of each whole text, then ``end_id``, cut every ``capacity``.

    A null text is empty and gives the piece ``[end_id]``; so does an empty one. Null ids stay null, rows that repeat are
    documents of their own, an empty table gives no pieces, and other columns are not read.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            holds = np.zeros(len(texts), bool)
            for x in encoder.added:
                holds |= pc.fill_null(pc.match_substring(texts, x), False).to_numpy(zero_copy_only=False)
            rest = pa.array([None if h else x for h, x in zip(holds, texts.to_pylist(), strict=True)], pa.large_string()) if holds.any() else texts
            for low, to, data, offsets in slices(rest):
                found, begin = encoder.ids(data, offsets, end_id)
                out: dict[str, list] = defaultdict(list)
                for k in range(low, to):
                    mine = found[begin[k - low] : begin[k - low + 1]]
                    if holds[k]:
                        mine = np.array([*encoder.inner.encode(texts[k].as_py(), add_special_tokens=False).ids, end_id], "<u4")
                    for piece, at in enumerate(range(0, len(mine), capacity)):
                        part = mine[at : at + capacity]
                        for name, value in zip(names, (ids[k], piece, at, len(part), zlib.crc32(part)), strict=False):
                            out[name].append(value)
                        if with_ids:
                            out["ids"].append(part.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds, strict=False)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).transform(text_batches).mapInArrow(encode, _PIECES + ", ids array<long>" * with_ids)


def places(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go, as rows (length, first_rank, n_items, per_bin, first_bin, offset).

    Item ``first_rank + j`` goes to bin ``first_bin + j // per_bin``, at ``offset + j % per_bin * length``.
    Items above a third of the capacity fit at most twice into a bin: the largest takes the largest other that fits.
    Smaller ones then go, from long to short, where they leave the least gap. Bins with the same gap are handled together,
    so the rows depend on the number of lengths and not on that of items: at most one row ends a length's items and every
    other one uses up a group of equal gaps.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    left = {k: n for k, n in counts.items() if n}
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> [first bin, bins]
    bins = 0

    def put(length: int, items: int, per_bin: int, first_bin: int, offset: int) -> None:
        rows.append((length, rank[length], items, per_bin, first_bin, offset))
        rank[length] += items
        left[length] -= items

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for length in large:
        while n := left[length]:
            other = next((k for k in large if k <= capacity - length and left[k] and k <= length), None)
            if other is None:
                pairs, gap = n, capacity - length
                put(length, n, 1, bins, 0)
            elif other == length:
                pairs, gap = n // 2, capacity - 2 * length
                if not pairs:  # a single one is left: it takes the next length that fits
                    other = next((k for k in large if k < length and left[k] and k <= capacity - length), None)
                    pairs, gap = 1, capacity - length - (other or 0)
                    put(length, 1, 1, bins, 0)
                    if other:
                        put(other, 1, 1, bins, length)
                else:
                    put(length, 2 * pairs, 2, bins, 0)
            else:
                pairs, gap = min(n, left[other]), capacity - length - other
                put(length, pairs, 1, bins, 0)
                put(other, pairs, 1, bins, length)
            if gap:
                gaps[gap].append([bins, pairs])
            bins += pairs
    open_gaps = sorted(gaps)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while n := left[length]:
            at = _at_least(open_gaps, length)
            if at is None:
                per_bin = capacity // length
                full, rest = divmod(n, per_bin)
                if full:
                    put(length, full * per_bin, per_bin, bins, 0)
                    _add(gaps, open_gaps, capacity - per_bin * length, [bins, full])
                    bins += full
                if rest:
                    put(length, rest, rest, bins, 0)
                    _add(gaps, open_gaps, capacity - rest * length, [bins, 1])
                    bins += 1
                continue
            gap = at
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.remove(gap)
            per_bin = gap // length
            whole = min(many, n // per_bin)
            offset = capacity - gap
            if whole:
                put(length, whole * per_bin, per_bin, first, offset)
                _add(gaps, open_gaps, gap - per_bin * length, [first, whole])
            elif n:
                put(length, n, n, first, offset)
                _add(gaps, open_gaps, gap - n * length, [first, 1])
                whole = 1
            if many > whole:
                _add(gaps, open_gaps, gap, [first + whole, many - whole])
    return rows


def _at_least(ordered: list[int], least: int) -> int | None:
    at = bisect_left(ordered, least)
    return ordered[at] if at < len(ordered) else None


def _add(gaps: dict[int, list[list[int]]], ordered: list[int], gap: int, group: list[int]) -> None:
    if gap <= 0:
        return
    if not gaps[gap]:
        insort(ordered, gap)
    gaps[gap].append(group)


def packed(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """``pieces`` with sequence_id and offset. Each length is 1 .. ``capacity``; other columns stay as they are.

    Rows that are alike in ``order`` may share a hash; their ranks still differ, since a window counts them one by one.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows = places(counts, capacity)
    table = spark.createDataFrame(rows or [], "len long, first_rank long, n_items long, per_bin long, first_bin long, base long")
    ranked = bucketed_before(pieces, ["length"], list(order), F.lit(1), "rank")
    fits = (ranked["length"] == table["len"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n_items"))
    j = F.col("rank") - F.col("first_rank")
    joined = ranked.join(F.broadcast(table), fits)  # as many rows as `places` gives: bounded by the capacity alone
    return joined.select(
        *(ranked[c] for c in pieces.columns),
        (F.col("first_bin") + F.floor(j / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(j, F.col("per_bin")) * F.col("len")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces, each with its sequence and its offset in it."""
    return packed(saved(token_pieces(docs, tokenizer, capacity, id_col, text_col)), capacity)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))

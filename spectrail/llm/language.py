"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of fixed length. Bytes become small vectors; filters that span 4, 6 and 8 bytes,
placed every 4 bytes, are max-pooled over a window, and a softmax layer gives the window's languages. A text's languages
are the mean over all of its windows, by their bytes. The network is trained in numpy on labelled text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrail.llm.tables import read, text_batches
from spectrail.llm.words import slices

WINDOW, STRIDE, EMBED, FILTERS = 256, 4, 8, 16
UNKNOWN = "und"
#: Bytes as kinds for pairs: a-z in either case, bytes beyond ASCII, and the rest, which separates.
_KIND = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else b - 128 + 27 if b > 127 else 0 for b in range(256)], np.int64)
_KINDS = 27 + 128
#: Share of labelled windows that each language's cutoff of familiarity keeps at least, of those it is chosen on, room below it in bits,
#: and how many such windows it takes; a language with fewer has no cutoff.
KEPT, ROOM, LEAST_WINDOWS = 0.995, 0.5, 100


@dataclass
class ByteNet:
    """Parameters: bytes' vectors, filters for the bytes at a place and for those of the next place, bias, softmax layer."""

    embed: np.ndarray  # (256, EMBED)
    here: np.ndarray  # (STRIDE * EMBED, 3 * FILTERS)
    after: np.ndarray  # (STRIDE * EMBED, 2 * FILTERS), of the filters of 6 and 8 bytes
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, classes: int, seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        k = STRIDE * EMBED
        net = cls(rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.2, (k, 3 * FILTERS)), rng.normal(0, 0.2, (k, 2 * FILTERS)), np.zeros(3 * FILTERS), rng.normal(0, 0.1, (3 * FILTERS, classes)), np.zeros(classes))
        for name, x in vars(net).items():
            setattr(net, name, x.astype(np.float32))
        return net._narrow()

    def _narrow(self) -> ByteNet:
        self.embed[0] = 0  # byte 0 fills up the last window
        self.after[2 * EMBED :, :FILTERS] = 0  # filters of 6 bytes end after two of the next place
        return self

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of the bytes (n, places, k), and for each filter its maximum over the places and where it is."""
        x = self.embed[windows].reshape(len(windows), WINDOW // STRIDE, STRIDE * EMBED)
        y = x.reshape(-1, STRIDE * EMBED) @ np.hstack([self.here, self.after])
        y = y.reshape(len(windows), WINDOW // STRIDE, -1)
        y[:, :-1, FILTERS : 3 * FILTERS] += y[:, 1:, 3 * FILTERS :]
        return x, y, y[:, :, : 3 * FILTERS].max(1) + self.bias

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(self.pooled(windows)[2], 0) @ self.out + self.out_bias)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        x, y, top = self.pooled(windows)
        at = y[:, :, : 3 * FILTERS].argmax(1)
        hidden = np.maximum(top, 0)
        error = _softmax(hidden @ self.out + self.out_bias)
        error[np.arange(len(labels)), labels] -= 1
        error /= len(labels)
        back = (error @ self.out.T) * (top > 0)
        row = np.arange(len(labels))[:, None]
        here = x[row, at]  # (n, filters, k)
        wide, has = at[:, FILTERS:] + 1, at[:, FILTERS:] + 1 < x.shape[1]
        after = x[row, np.minimum(wide, x.shape[1] - 1)] * has[..., None]
        dx = np.zeros_like(x)
        np.add.at(dx, (row, at), back[..., None] * self.here.T[None])
        np.add.at(dx, (row, np.minimum(wide, x.shape[1] - 1)), (back[:, FILTERS:] * has)[..., None] * self.after.T[None])
        embed = np.zeros_like(self.embed)
        np.add.at(embed, windows.reshape(-1), dx.reshape(-1, EMBED))
        return {"embed": embed, "here": np.einsum("nf,nfk->kf", back, here), "after": np.einsum("nf,nfk->kf", back[:, FILTERS:], after), "bias": back.sum(0), "out": hidden.T @ error, "out_bias": error.sum(0)}


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def fit(windows: np.ndarray, labels: np.ndarray, classes: int, steps: int = 500, batch: int = 96, rate: float = 0.004, seed: int = 11) -> ByteNet:
    """Adam on batches that take the classes in turn."""
    net, rng = ByteNet.new(classes, seed), np.random.default_rng(seed)
    own = [np.flatnonzero(labels == c) for c in range(classes)]
    own = [x for x in own if len(x)]
    first, second = ({k: np.zeros_like(v) for k, v in vars(net).items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, max(1, batch // len(own))) for x in own])
        for name, g in net.gradients(windows[pick], labels[pick]).items():
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            slow = rate * min(1, 2 * (1 - step / (steps + 1)))
            getattr(net, name)[...] -= slow * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
        net._narrow()
    return net


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts that lie one after the other: bytes (n, WINDOW), the text's row, and how many bytes are its own."""
    sizes = offsets[1:] - offsets[:-1]
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][row] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[1:][row] - begin)
    out = np.zeros((len(row), WINDOW), np.uint8)
    place = np.arange(WINDOW)[None, :]
    inside = place < length[:, None]
    out[inside] = data[(begin[:, None] + place)[inside]]
    return out, row, length


@dataclass
class Pairs:
    """How usual pairs of letters are in each language: log2 of their smoothed shares, and a cutoff by the number of pairs.

    A softmax over languages says which one fits best, not whether any does; a text's mean over its pairs does.
    The cutoff is ``level - slope / sqrt(pairs)`` bits.
    """

    logs: np.ndarray  # (languages, kinds * kinds)
    level: np.ndarray
    slope: np.ndarray

    @classmethod
    def of(cls, windows: np.ndarray, labels: np.ndarray, classes: int) -> Pairs:
        """From half of the windows, with the cutoffs from the other half."""
        half = np.arange(len(windows)) % 2 == 0
        logs = []
        for c in range(classes):
            code, good = _pairs(windows[half & (labels == c)])
            counts = np.bincount(code[good], minlength=_KINDS**2).reshape(_KINDS, _KINDS) + 0.01
            logs.append(np.log2(counts / counts.sum(axis=1, keepdims=True)).reshape(-1))
        found = cls(np.array(logs, np.float32), np.zeros(classes), np.zeros(classes))
        for c in range(classes):
            mine = windows[~half & (labels == c)]
            total, n = found.sums(mine, np.full(len(mine), c))
            mean, root = total[n > 0] / n[n > 0], np.sqrt(n[n > 0])
            if len(mean) < LEAST_WINDOWS:
                found.level[c] = -np.inf
                continue
            # long windows set the level, and the slope takes in the short ones
            found.level[c] = np.quantile(mean[n[n > 0] >= np.median(n[n > 0])], 1 - KEPT) - ROOM
            found.slope[c] = max(0.0, np.quantile((found.level[c] - mean) * root, KEPT)) + 2
        return found

    def sums(self, windows: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window, the sum over its pairs in its language, and their number."""
        code, good = _pairs(windows)
        flat = self.logs[language[:, None], code]
        return np.where(good, flat, 0).sum(axis=1), good.sum(axis=1)

    def familiar(self, total: np.ndarray, n: np.ndarray, language: np.ndarray) -> np.ndarray:
        """How many bits a pair the mean lies above the cutoff; texts without pairs lie at 0."""
        some = np.maximum(n, 1)
        return np.where(n > 0, total / some - self.level[language] + self.slope[language] / np.sqrt(some), 0.0)


def _pairs(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of neighbouring kinds, and which of them hold a letter."""
    kind = _KIND[windows]
    return kind[:, :-1] * _KINDS + kind[:, 1:], (kind[:, :-1] > 0) | (kind[:, 1:] > 0)


def _sampled(per_text: int):
    """Rows (label, text) to rows (label, window): some windows of each text, at even distances."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, to, data, offsets in slices(batch.column(1)):
                made, row, _ = windows_of(data, offsets)
                counts = np.bincount(row, minlength=to - first)
                start = np.cumsum(counts) - counts
                take = np.unique(np.concatenate([start[counts > 0] + (counts[counts > 0] - 1) * i // max(1, per_text - 1) for i in range(per_text)]) if len(row) else np.zeros(0, np.int64))
                labels = batch.column(0).slice(first, to - first).take(pa.array(row[take]))
                yield pa.RecordBatch.from_arrays([labels, pa.array([x.tobytes() for x in made[take]], pa.binary())], ["label", "window"])

    return each


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", texts_per_label: int = 700, per_text: int = 3, steps: int = 500) -> tuple[list[str], ByteNet, Pairs] | None:
    """Languages, a network and pairs of letters, from about ``texts_per_label`` texts of each label (by a hash of text and id); None without labelled text.

    The driver gets at most about ``texts_per_label * per_text`` windows of each label and one row for each label.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(text_col, id_col).alias("hash"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, texts_per_label / n))])
    chosen = rows.where(F.pmod("hash", F.lit(1_000_003)) < F.element_at(share, F.col("label")) * 1_000_003).select("label", "text")
    found = chosen.transform(text_batches).mapInArrow(_sampled(per_text), "label string, window binary").collect()
    found = sorted((r["label"], bytes(r["window"])) for r in found)
    labels = sorted(counts)
    data = np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, WINDOW)
    own = np.array([labels.index(k) for k, _ in found])
    return labels, fit(data, own, len(labels), steps), Pairs.of(data, own, len(labels))


def _scored(text_at: int, columns: int, net: ByteNet | None, names: list[str], schema_names: list[str], pairs: Pairs | None = None):
    """Batches with a text and a flag (whether it has a letter, last) to their first columns, language, score and, with ``pairs``, familiarity."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = np.asarray(batch.column(batch.num_columns - 1).fill_null(False))
            pred, score, known = np.full(len(letters), -1), np.zeros(len(letters)), np.zeros(len(letters))
            for first, to, data, offsets in slices(batch.column(text_at), 1 << 18) if net is not None else ():
                made, row, length = windows_of(data, offsets)
                if not len(row):
                    continue
                # few windows at a time, so that what lies between stays in the cache; a very long text is no exception
                chance = np.concatenate([net.probabilities(made[i : i + 64]) for i in range(0, len(made), 64)])
                total = np.zeros((to - first, len(names)))
                np.add.at(total, row, chance * length[:, None])
                sums = total.sum(1)
                fine = (sums > 0) & letters[first:to]
                at = first + np.flatnonzero(fine)
                pred[at] = total[fine].argmax(1)
                score[at] = np.clip(total[fine].max(1) / sums[fine], 0, 1)
                if pairs is not None:
                    language = np.maximum(total.argmax(1), 0)
                    parts = [pairs.sums(made[i : i + 256], language[row[i : i + 256]]) for i in range(0, len(made), 256)]
                    bits, n = (np.bincount(row, np.concatenate([p[k] for p in parts]), to - first) for k in range(2))
                    known[at] = pairs.familiar(bits, n, language)[fine]
            labels = pa.array([UNKNOWN if p < 0 else names[p] for p in pred], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(columns)), labels, pa.array(score), *([pa.array(known)] if pairs is not None else [])], schema_names)

    return each


def identify(docs: DataFrame, model: tuple[list[str], ByteNet, Pairs] | None, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",), familiarity: bool = False) -> DataFrame:
    """(*columns, lang_pred, score[, familiar]) for each row: the language of the whole text and its mean chance over the windows.

    ``familiar`` tells by how many bits a pair of letters the text lies above what texts of that language reach; below 0 it
    is in none of the languages. ``und`` with score 0 where the text is null or has no letter, or without a model. Only the text is looked at.
    Repeated rows give repeated results; an empty table gives an empty result. ``columns`` that are called like the results
    are refused.
    """
    if {"lang_pred", "score", "familiar"} & set(columns):
        raise ValueError("columns named lang_pred, score or familiar would clash with the results")
    schema = T.StructType([docs.schema[c] for c in columns]).add("lang_pred", "string").add("score", "double")
    if familiarity:
        schema = schema.add("familiar", "double")
    rows = docs.select(*columns, F.col(text_col).alias("_text"), F.col(text_col).rlike(r"\p{L}").alias("_letters"))
    each = _scored(len(columns), len(columns), model[1] if model else None, model[0] if model else [], schema.names, None if not familiarity else model[2] if model else Pairs(np.zeros((1, _KINDS**2)), np.zeros(1), np.zeros(1)))
    return rows.transform(text_batches).mapInArrow(each, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text has remainder 2 by 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return identify(docs, train(docs.where("not held_out")), columns=("doc_id", "held_out"))

"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The field then labels every token with a digit
or an at sign: its features are the token, its run of neighbouring tokens, the words before it and what patterns say of it.
Neighbours in a run share potentials, and so do distant tokens of a document that are equal, end in the same digits or stand in
runs that do (each with the next such one, so edges are no more than a few times the tokens). Loopy message passing runs over all documents of a batch at once
and makes labels agree across each document: a number that is a phone number where it has a plus sign and a word before it
is one wherever it returns. Spans of labelled tokens that no pattern found are added.

No table has labelled spans, so the weights are learned from documents made by rule (``made_document``); their labels
are known by construction. Expected counts of the gradient come from the same message passing.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrail.llm.tables import fresh, read, text_batches

KINDS = ("email", "ip", "card", "phone")
#: Labels of tokens: none of them, then the kinds.
LABELS = ("other", *KINDS)
#: Rounds of message passing, the share of an old message that stays, and the least belief of a span's tokens.
ROUNDS, DAMPING, LEAST = 10, 0.3, 0.9
#: Documents whose tokens are labelled at once.
TOGETHER = 200
#: Documents made for training, and steps of the fit.
MADE, STEPS = 1_000, 100

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")


def luhn(digits: str) -> bool:
    """Whether the sum of the digits, every second one from the right doubled and its digits added, is a multiple of ten."""
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(x // 10 + x % 10 for x in twice)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches from left to right in linear time: each at sign takes what stands before it back to the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers with dots, each at most 255; longer chains are taken by fours."""
    for chain in _NUMBERS.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts = [(chain.start() + m.start(), chain.start() + m.end(), m[0]) for m in _DIGITS.finditer(chain[0])]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for _, _, p in four):
                yield four[0][0], four[3][1]


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all patterns' matches, by kind and start."""
    if not any(c in text for c in "0123456789@"):
        return []
    return [(k, *span) for k, find in enumerate((emails, addresses, cards, phones)) for span in find(text)]


# Words that tell what a number is, in the languages of the texts.
TELLING = {
    "phone": "phone tel telephone call mobile cell fax dial whatsapp telefon anruf handy rufnummer telefono teléfono móvil llame llamar telephone téléphone appelez portable",
    "card": "card visa mastercard amex credit debit karte kreditkarte tarjeta carte bancaire",
    "ip": "ip ipv4 host server client ping address gateway login adresse servidor serveur",
    "email": "mail email e-mail contact write reply sender from correo courriel schreiben",
    "thing": "order invoice page id version isbn no number nr rechnung pedido commande token key serial total sum price year chapter row figure table sku ref article",
}
_TELLS = {w: k for k, words in TELLING.items() for w in words.split()}
_EDGE = " \t,;:!?\"'|<>%#*&$.[]{}=~^`_/\\"


class Graph:
    """Tokens of some documents with their features, and edges in a run (type 0), of equal tokens (1) and of like numbers (2)."""

    def __init__(self):
        self.features: list[list[int]] = []
        self.spans: list[tuple[int, int, int, int]] = []  # document, start, end, run
        self.edges: list[tuple[int, int, int]] = []
        self._runs = 0

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        first, seen = len(self.spans), {}
        self._like: dict[str, list[int]] = {}
        found = []
        for m in _TOKEN.finditer(text):
            start, end = m.span()
            while start < end and text[start] in _EDGE:
                start += 1
            while end > start and text[end - 1] in _EDGE:
                end -= 1
            core = text[start:end]
            if core:
                found.append((start, end, core))
        marks = _covering(found, base)
        run: list[int] = []
        for i, (start, end, core) in enumerate(found):
            if run and not (text[found[i - 1][1] : start].strip(" \t") == "" and start - found[i - 1][1] <= 2):
                self._close(run, found, text, first)
                run = []
            run.append(i)
            self.spans.append((doc, start, end, self._runs))
            self.features.append(_of_token(core, marks[i], _before(text, start)))
            node, digits = first + i, "".join(_DIGITS.findall(core))
            for key in {core.lower(), digits[-7:] if len(digits) >= 7 else ""}:
                if len(key) > 2:
                    if key in seen:
                        self.edges.append((seen[key], node, 1 if key == core.lower() else 2))
                    seen[key] = node
        if run:
            self._close(run, found, text, first)

    def _close(self, run: list[int], found: list, text: str, first: int) -> None:
        """Edges and features of a run that ends."""
        digits = "".join(d for i in run for d in _DIGITS.findall(found[i][2]))
        own = [_name(f"run of {min(len(run), 5)}"), _name(f"run digits {_bucket(len(digits))}")]
        if 13 <= len(digits) <= 19:
            own.append(_name(f"run luhn {luhn(digits)}"))
        for i in run:
            self.features[first + i] += own
        self.edges += [(first + a, first + b, 0) for a, b in zip(run, run[1:])]
        if len(digits) >= 7:  # tokens of like runs meet from the end
            here = [first + i for i in reversed(run)]
            self.edges += [(a, b, 2) for a, b in zip(self._like.get(digits[-7:], []), here)]
            self._like[digits[-7:]] = here
        self._runs += 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of features by token (as pairs), and edges."""
        sizes = [len(x) for x in self.features]
        rows = np.repeat(np.arange(len(sizes)), sizes)
        return rows, np.fromiter((f for x in self.features for f in x), np.int64, sum(sizes)), np.array(self.edges, np.int64).reshape(-1, 3)


#: Room for features; names are numbered by their hash.
ROOM = 1 << 12


@cache
def _name(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % ROOM


def _bucket(n: int) -> str:
    return str(n) if n < 13 else "13-19" if n < 20 else "20+"


def _covering(found: list, base: list[tuple[int, int, int]]) -> list[list[int]]:
    """For each token the kinds of the patterns' matches that touch it; both lists are in order, kind by kind."""
    out: list[list[int]] = [[] for _ in found]
    for kind in range(len(KINDS)):
        own, i = [(s, e) for k, s, e in base if k == kind], 0
        for s, e in own:
            while i < len(found) and found[i][1] <= s:
                i += 1
            j = i
            while j < len(found) and found[j][0] < e:
                out[j].append(kind)
                j += 1
    return out


def _before(text: str, start: int) -> list[str]:
    """The three words before a place, the nearest first; a word counts by its last 40 characters at most."""
    words = text[max(0, start - 123) : start].split()[-3:][::-1]
    return [w.strip(_EDGE + "()").lower()[-40:] for w in words]


def _of_token(core: str, marks: list[int], before: list[str]) -> list[int]:
    n = sum(map(len, _DIGITS.findall(core)))
    out = ["any", f"digits {_bucket(n)}", "letters" if any(map(str.isalpha, core)) else "no letters"]
    out += [f"has {c}" for c in "+()-.:/=@$€" if c in core]
    out += [f"pattern {KINDS[k]}" for k in marks] or ["no pattern"]
    if core.count(".") == 3 and core.replace(".", "").isdigit():
        out.append("four numbers")
    if core.isdigit():
        out.append("number")
    if len(core) > 20:
        out.append("long")
    for place, word in enumerate(before):
        if word in _TELLS:
            out += [f"told {_TELLS[word]}", f"told {_TELLS[word]} {_bucket(n)}", f"told {_TELLS[word]} at {place}"]
    return [_name(x) for x in out]


class Field:
    """Weights: of features by label, and of edge types by pair of labels."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def beliefs(self, graph: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of tokens, and of edges as pairs of labels, after some rounds of sum-product message passing."""
        rows, features, edges = graph
        k = len(LABELS)
        phi = _summed(rows, self.unary[features], n)
        a, b, psi = edges[:, 0], edges[:, 1], self.pair[edges[:, 2]]
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        both = np.concatenate([psi, psi.transpose(0, 2, 1)])
        message, e = np.zeros((len(source), k)), len(a)
        opposite = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        for _ in range(rounds if e else 0):
            total = phi + _summed(target, message, n)
            out = _logsum((total[source] - message[opposite])[:, :, None] + both, 1)
            out -= _logsum(out, 1)[:, None]
            message = DAMPING * message + (1 - DAMPING) * out
        total = phi + _summed(target, message, n)
        node = np.exp(total - _logsum(total, 1)[:, None])
        joint = (total[a] - message[opposite[:e]])[:, :, None] + (total[b] - message[:e])[:, None, :] + psi
        joint = np.exp(joint - _logsum(joint.reshape(e, -1), 1)[:, None, None]) if e else np.zeros((0, k, k))
        return node, joint


def _summed(place: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``x`` by their place."""
    return np.stack([np.bincount(place, x[:, j], n) for j in range(x.shape[1])], axis=1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


_FILLER = "the of and to in was for that with on at by der die und das ein zu el la de que y en le les des est une pour Lorem report data shows value line then after before".split()


def made_document(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text made by rule and its true spans: entities in full and in plainer forms, and numbers that are none."""
    parts: list[tuple[str, int | None]] = []

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def say(kind: str) -> str:
        return rng.choice(TELLING[kind].split()) + rng.choice(["", ":", " is", " at"])

    def card() -> str:
        x = digits(15)
        return next(x + d for d in "0123456789" if luhn(x + d))

    def phone_forms(p: tuple[str, str, str]) -> list[str]:
        a, b, c = p
        return [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"{a}{b}{c}"]

    filler = lambda: " ".join(rng.choice(_FILLER) for _ in range(rng.randrange(2, 9)))
    entities = [(rng.randrange(4)) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))]
    for kind in entities:
        number = (digits(3), digits(3), digits(4))
        number = (rng.choice("23456789") + number[0][1:], *number[1:])
        forms = {0: None, 1: None, 2: None, 3: phone_forms(number)}[kind]
        plain, c = f"{rng.choice(_FILLER)}.{digits(2)}@mail{rng.randrange(9)}.example.com", card()
        address = ".".join(str(rng.randrange(256)) for _ in range(4))
        for again in range(rng.choice([1, 1, 2, 3])):
            told = rng.random() < 0.5
            if kind == 0:
                form = plain if again == 0 or rng.random() < 0.7 else plain.upper()
            elif kind == 1:
                form = address
            elif kind == 2:
                form = rng.choice([c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4))])
            else:
                form = forms[0] if again == 0 and rng.random() < 0.8 else rng.choice(forms[1:])
                told = told or (again == 0 and form != forms[0])
            parts += [(filler(), None), *([(say(KINDS[kind]), None)] if told else []), (form, kind)]
    for _ in range(rng.randrange(0, 7)):
        none = rng.choice(
            [digits(rng.randrange(1, 7)), f"{digits(2)}.{digits(2)}", f"{digits(3)}-{digits(4)}", digits(10), digits(8), digits(16)[:-1] + "x", f"{digits(1)}.{digits(2)}.{digits(1)}", f"20{digits(2)}-0{rng.randrange(1, 10)}-{digits(2)}"]
            + [f'"{hashlib.sha1(digits(9).encode()).hexdigest()}"', f"{digits(3)} {digits(3)} {digits(4)}", f"${digits(3)}", f"{digits(2)}:{digits(2)}", "@" + rng.choice(_FILLER), f"{digits(4)} {digits(4)}", f"v{digits(1)}.{digits(1)}", f"{digits(3)}.{digits(3)}.{digits(3)}"]
            + [digits(rng.randrange(11, 24)), f"{digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(4)}"]
        )
        none = none if rng.random() < 0.8 else f"{none} {filler()} {none}"
        at = rng.randrange(len(parts) + 1)
        if at and at < len(parts) and parts[at][1] is not None:
            at = len(parts)
        parts.insert(at, (f"{filler()} {say('thing') if rng.random() < 0.5 else rng.choice(_FILLER)} {none}", None))
    parts.append((filler(), None))
    text, spans = "", []
    for x, kind in parts:
        text += " " if text else ""
        if kind is not None:
            spans.append((kind, len(text), len(text) + len(x)))
        text += x + (rng.choice(["", ",", "."]) if kind is not None else "")
    return text, spans


def labelled(n: int, seed: int) -> tuple[Graph, np.ndarray]:
    """The graph of ``n`` made documents and the true labels of its tokens: a pattern's match is always one of its kind."""
    rng, graph, truth = random.Random(seed), Graph(), []
    for doc in range(n):
        text, spans = made_document(rng)
        first, base = len(graph.spans), patterns(text)
        graph.add(doc, text, base)
        for _, start, end, _ in graph.spans[first:]:
            truth.append(next((k + 1 for k, s, e in [*spans, *base] if s < end and start < e), 0))
    return graph, np.array(truth)


@cache
def trained(n: int = MADE, steps: int = STEPS, seed: int = 7) -> Field:
    """The field fitted to ``n`` made documents by gradients of the likelihood under message passing (Adam, a small L2 penalty)."""
    graph, truth = labelled(n, seed)
    rows, features, edges = graph.arrays()
    k, size = len(LABELS), len(truth)
    field = Field(np.zeros((ROOM, k)), np.zeros((3, k, k)))
    seen_unary, seen_pair = np.zeros((ROOM, k)), np.zeros((3, k, k))
    np.add.at(seen_unary, (features, truth[rows]), 1)
    np.add.at(seen_pair, (edges[:, 2], truth[edges[:, 0]], truth[edges[:, 1]]), 1)
    slots = [[np.zeros_like(w), np.zeros_like(w)] for w in (field.unary, field.pair)]
    for step in range(1, steps + 1):
        node, joint = field.beliefs((rows, features, edges), size)
        want_unary = _summed(features, node[rows], ROOM)
        want_pair = _summed(edges[:, 2], joint.reshape(-1, k * k), 3).reshape(3, k, k)
        for w, seen, want, slot in ((field.unary, seen_unary, want_unary, slots[0]), (field.pair, seen_pair, want_pair, slots[1])):
            g = (want - seen) / size + 2e-4 * w
            slot[0] = 0.9 * slot[0] + 0.1 * g
            slot[1] = 0.99 * slot[1] + 0.01 * g * g
            w -= 0.15 * (slot[0] / (1 - 0.9**step)) / (np.sqrt(slot[1] / (1 - 0.99**step)) + 1e-8)
    return field


def added(graph: Graph, node: np.ndarray, bases: dict[int, list[tuple[int, int, int]]], least: float = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of neighbouring tokens with one sure label, where they touch no pattern's match: (kind, start, end) by document."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    label = np.where(node.max(axis=1) >= least, node.argmax(axis=1), 0) if len(node) else np.zeros(0, int)
    at, spans = 0, graph.spans
    while at < len(spans):
        kind, stop = int(label[at]), at + 1
        while stop < len(spans) and label[stop] == kind and spans[stop][3] == spans[at][3]:
            stop += 1
        if kind:
            doc, start, end = spans[at][0], spans[at][1], spans[stop - 1][2]
            out.setdefault(doc, []).append((kind - 1, start, end))
        at = stop
    for doc, own in out.items():
        base = sorted((s, e) for _, s, e in bases[doc])
        starts = [s for s, _ in base]
        furthest = np.maximum.accumulate([e for _, e in base]).tolist() if base else []
        free = lambda s, e: (i := int(np.searchsorted(starts, e, "left"))) == 0 or furthest[i - 1] <= s  # noqa: B023, E731
        out[doc] = [x for x in own if free(x[1], x[2])]
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(documents: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """Adds ``base`` and ``added``, arrays of (kind, start, end) in code points, by kind and start.

    ``base`` are the patterns' matches, ``added`` what the field finds besides with a belief of at least ``least``. Null and empty texts have
    none; texts count whole, in time in proportion to their length. Rows are looked at one by one, so repeated rows, equal
    ids and empty tables are no special cases; other columns stay, and where one is called ``base`` or ``added`` already,
    the new one gets underscores behind its name.
    """
    field, (base, more) = trained(), fresh(documents, "base", "added")
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
            graph, bases = Graph(), {}
            for doc, cell in enumerate(batch[text]):
                own = cell.as_py() or ""
                bases[doc] = patterns(own)
                graph.add(doc, own, bases[doc])
            node, _ = field.beliefs(graph.arrays(), len(graph.spans))
            found = added(graph, node, bases, least)
            lists = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(own.get(d, []))] for d in range(batch.num_rows)], pa.list_(span)) for own in (bases, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, base, more])

    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return text_batches(documents).mapInArrow(run, T.StructType([*documents.schema, T.StructField(base, kind), T.StructField(more, kind)]))


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and a digest of the patterns' spans, and all spans as text."""
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda spans, kind: F.filter(spans, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind("base", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.concat(*[F.array_sort(of_kind(F.concat("base", "added"), k)) for k in KINDS])
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written(every).alias("spans"))

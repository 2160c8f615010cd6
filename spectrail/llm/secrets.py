"""Secret scans with a random forest that removes false positives.

Patterns give candidates: values with a known form, values assigned to a telling name, and long runs of key characters.
A forest of decision trees, trained in numpy on labelled findings, then judges each one by its length, the transitions
between its characters, how much of it dictionary words cover, its path and the words beside it.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm.tables import fresh, read, text_batches

# Words that names of secrets hold, and words beside values that are none.
NAMES = ("token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "auth", "credential", "bearer", "key")
HARMLESS = ("example", "sample", "dummy", "test", "mock", "fake", "placeholder", "commit", "sha", "hash", "checksum", "digest", "uuid", "guid", "revision", "etag", "version", "isbn", "order", "card", "phone", "changeme", "your", "xxxx")
# Forms of keys of public services.
FORMS = (
    ("aws", r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("github", r"gh[pousr]_[0-9A-Za-z]{36,}"),
    ("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    ("stripe", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("google", r"AIza[0-9A-Za-z_-]{35}"),
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)"),
)
# A small dictionary, in alphabetic order.
WORDS = (
    "about access account action address admin after again agent algorithm allow always another answer api app application array author "
    "backup base before being between block body branch browser buffer build button bytes cache call case change channel check class "
    "client close cloud code column command commit common config connect content context control copy count create current data database "
    "date day debug default delete demo deploy device directory docker document domain down each email enable encode end engine error "
    "event example file filter find first folder form format from function group handler hash header hello host image import index info "
    "input internal item job just key know label language last latest layer length level library line link list local login machine main "
    "manager map master memory message method model module most name network never node note number object only open option order other "
    "output over package page parent pass password path people place plugin point port process product profile project public query "
    "queue read record region release remote report request response result return right role root route sample schema script search "
    "secret section server service session setting should simple size source stage start state static status step storage stream string "
    "style system table target task template test text than that their them there this thread time title token tool tree type under unit "
    "update upload user value variable version very view want water web when where which window with word work world would write year your"
).split()
_RUN = r"[0-9A-Za-z+/_=-]"
_FORM = re.compile("|".join(f"(?P<f{i}>(?<![0-9A-Za-z_]){p})" for i, (_, p) in enumerate(FORMS)))
_NAME = re.compile("|".join(map(re.escape, NAMES)))
_NAME_END = re.compile(r"[\w.-]*+")
_SIGN = re.compile(r"[\"']?+[ \t]*+(?:=>|:=|[:=])[ \t]*+")
_QUOTED = {q: re.compile(rf"{q}([^{q}\n]*+){q}") for q in "\"'"}
_VALUE = re.compile(r"\S+")
_LONG = re.compile(_RUN + "{20,}+")
_WIDE = re.compile(r"(?<!\S)\S{20,}+")
_JWT = re.compile(r"(?<![0-9A-Za-z_])eyJ[0-9A-Za-z_-]{8,}+")
_PART = re.compile(r"\.([0-9A-Za-z_-]*+)")
_KEY_START = "-----BEGIN "
_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_", "rk_", "AIza", _KEY_START)
_NEAR = re.compile(r"\S+")
#: Small letters in places that stay: A-Z and the Kelvin sign, all that becomes one of a-z.
_LOWER = str.maketrans(string.ascii_uppercase + "\u212a", string.ascii_lowercase + "k")
LABEL = "[secret]"
#: Characters of an assigned value at least, and of a value's surroundings that the forest may look at.
LEAST_VALUE, BEFORE, AFTER = 8, 60, 30
FEATURES = 24


def suspect(text: Column) -> Column:
    """Whether a text can hold a candidate at all; every pattern needs one of these."""
    low = F.lower(text)
    found = text.rlike(_RUN + "{20}") | text.contains("-----BEGIN ") | text.contains("eyJ")
    for part in ("token", "secret", "passw", "pwd", "key", "auth", "credential", "bearer", "xox", "k_live", "k_test"):
        found = found | low.contains(part)
    return F.coalesce(found, F.lit(False))


def _places(text: str, parts: Sequence[str]) -> list[int]:
    """Where one of the parts begins, in order."""
    out = []
    for part in parts:
        at = text.find(part)
        while at >= 0:
            out.append(at)
            at = text.find(part, at + 1)
    return sorted(out)


def _forms(text: str) -> Iterator[tuple[int, int, str]]:
    """Values of known forms; each is looked for where its first characters stand, and behind what was found before."""
    end = 0
    for at in _places(text, _STARTS):
        m = _FORM.match(text, at) if at >= end else None
        if m:
            end = m.end()
            yield at, end, FORMS[int(m.lastgroup[1:])][0]


def _jwts(text: str) -> Iterator[tuple[int, int, str]]:
    """Three parts with dots between; each part is read once, whether or not it belongs to one."""
    at = text.find("eyJ")
    while at >= 0:
        m = _JWT.match(text, at)
        if not m:
            at = text.find("eyJ", at + 1)
            continue
        second = _PART.match(text, m.end())
        third = _PART.match(text, second.end()) if second and len(second[1]) >= 8 else None
        if third and len(third[1]) >= 4:
            yield at, third.end(), "jwt"
        at = text.find("eyJ", third.end() if third and len(third[1]) >= 4 else m.end())


def _assigned(text: str, low: str) -> Iterator[tuple[int, int, str]]:
    """Values behind a name that holds a telling part, however long either is.

    A value in quotes goes on to the same quote on its line; any other to white space, without the punctuation at its end.
    """
    m = _NAME.search(low)
    while m:
        end = _NAME_END.match(text, m.end()).end()
        sign = _SIGN.match(text, end)
        if sign:
            start, first = sign.end(), text[sign.end() : sign.end() + 1]
            quoted = _QUOTED[first].match(text, start) if first in _QUOTED else None
            if quoted:
                start, stop = quoted.span(1)
            else:
                start += first in _QUOTED
                bare = _VALUE.match(text, start)
                stop = start + len(bare[0].rstrip(",;.)]}>\"'")) if bare else start
            if stop - start >= LEAST_VALUE:
                yield start, stop, "assigned"
                end = stop
        m = _NAME.search(low, end)


def _long_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs of 20 characters of keys or more, with a digit in them or behind them before the next white space."""
    for wide in _WIDE.finditer(text):
        last = max(wide[0].rfind(d) for d in string.digits) + wide.start()
        for m in _LONG.finditer(text, *wide.span()):
            if last >= m.start() and last >= wide.start():
                yield *m.span(), "long-run"


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what may be a secret, without overlaps: known forms first, then assigned values, then long runs.

    The time is in proportion to the text's length.
    """
    found: list[tuple[int, int, str]] = []
    ends: list[int] = []  # of what is found so far, which is kept in order
    for search in (_forms(text), _jwts(text), _assigned(text, text.translate(_LOWER)), _long_runs(text)):
        new = []
        for start, end, kind in search:
            at = bisect_right(ends, start)
            if at == len(found) or found[at][0] >= end:
                new.append((start, end, kind))
        found = sorted(found + new)
        ends = [x[1] for x in found]
    return found


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


#: At each place the longest word of the dictionary there, which holds all shorter ones there.
_WORDS_AT = re.compile("(?=(" + "|".join(sorted((w for w in WORDS if len(w) >= 4), key=len, reverse=True)) + "))")
_COMMON = {a + b for w in WORDS for a, b in zip(w, w[1:])}


def features(value: str, kind: str, before: str, after: str, path: str) -> list[float]:
    """``FEATURES`` numbers that the forest looks at."""
    n, low = max(1, len(value)), value.lower()
    counts = [value.count(c) for c in set(value)]
    kinds = [_kind(c) for c in value]
    share = lambda k: sum(x == k for x in kinds) / n
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / n
    letters = [(a, b) for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()]
    usual = sum(a + b in _COMMON for a, b in letters) / max(1, len(letters))
    covered, reach = 0, 0
    for m in _WORDS_AT.finditer(low):
        covered += max(0, m.end(1) - max(reach, m.start()))
        reach = max(reach, m.end(1))
    words_before = [w.lower() for w in _NEAR.findall(before)][-4:]
    near, behind = " ".join(words_before), after.lower()[:24]
    last = words_before[-1] if words_before else ""
    names = lambda s: float(any(x in s for x in NAMES))
    harmless = lambda s: float(any(x in s for x in HARMLESS))
    return [
        math.log2(n), -sum(c / n * math.log2(c / n) for c in counts), len(counts) / n, share(0), share(1), share(2), share(3), changes, usual, len(letters) / n,
        covered / n, float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None), float(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value) is not None),
        float(kind not in ("assigned", "long-run")), float(kind == "assigned"), names(near), harmless(near), names(last), float(before.rstrip("\"' ")[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'")),
        harmless(behind), harmless(low), harmless(path.lower()), float(max(counts, default=0) > 0.4 * n or "/" in value and covered > 0),
    ]


@dataclass
class Forest:
    """Trees as arrays of nodes: feature (-1: leaf), threshold, child if at most that, child if above, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, limit, low, high, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] <= limit[node], low[node], high[node])
            total += share[at]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 5) -> Forest:
    """Trees on bootstrap samples; each split takes the best Gini gain of a few random features."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, level: int, nodes: list[list[float]] = nodes) -> int:
            me, positive = len(nodes), float(y[rows].mean())
            nodes.append([-1, 0.0, 0, 0, positive])
            if level == depth or len(rows) < 2 * least or positive in (0.0, 1.0):
                return me
            best: tuple[float, int, float] | None = None
            for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
                values = x[rows, f]
                limits = np.unique(np.quantile(values, np.linspace(0.04, 0.96, 12)))
                left = values[:, None] <= limits[None, :]
                n = left.sum(0)
                p = (left & (y[rows] == 1)[:, None]).sum(0)
                m, q = len(rows) - n, y[rows].sum() - p
                good = (n >= least) & (m >= least)
                if good.any():
                    impurity = np.where(good, p * (1 - p / np.maximum(n, 1)) + q * (1 - q / np.maximum(m, 1)), np.inf)
                    k = int(impurity.argmin())
                    if best is None or impurity[k] < best[0]:
                        best = (float(impurity[k]), int(f), float(limits[k]))
            if best is None or best[0] >= len(rows) * positive * (1 - positive) - 1e-12:
                return me
            mask = x[rows, best[1]] <= best[2]
            low, high = split(rows[mask], level + 1), split(rows[~mask], level + 1)
            nodes[me] = [best[1], best[2], low, high, positive]
            return me

        split(rng.integers(0, len(x), len(x)), 0)
        a = np.array(nodes)
        out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Forest(out)


def labelled_findings(n: int = 3000, seed: int = 3) -> list[tuple[str, str, str, str, str, int]]:
    """(value, kind, before, after, path, 1 for a secret): labelled findings made by rule, for want of a labelled table.

    Secrets are random values of known forms, and random values assigned to telling names or standing bare beside them: behind
    "Bearer", in tables, on a line below, after a blank. What is none are ids, digests, placeholders, identifiers, paths, card
    and order numbers and long words, alone, assigned or in the same places.
    """
    r = random.Random(seed)
    prose = lambda: " ".join(r.choice(WORDS) for _ in range(4))
    chars = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexes, both, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    paths = ["src", "config", "web", "docs", "mail", "src0", "src7", "notes", "tests/mock", "examples"]
    out = []
    for _ in range(n):
        path, after = r.choice(paths), r.choice(["", " ", "\"", "'", "\n"]) + prose()
        name = r.choice(["token", "api_key", "API_KEY", "secret", "password", "db_password", "auth_token", "access_key", "client_secret", "SECRET_KEY", "bearer"])
        assign = f"{prose()} {name}{r.choice([' = ', '=', ': ', ':'])}{r.choice(['', chr(34), chr(39)])}"
        plain = f"{prose()} {r.choice(['', '', '(', 'and '])}"
        kind = r.randrange(27)
        if kind < 5:
            out.append((chars(hexes, r.choice([24, 32, 32, 40, 40, 48, 64])), "assigned", assign, after, path, 1))
        elif kind < 7:
            out.append((chars(both + r.choice(["", "+/", "_-"]), r.randint(16, 64)), "assigned", assign, after, path, 1))
        elif kind == 7:
            out.append((chars(both + r.choice(["!@#$%^&*", "!#$%,;.:<>?"]), r.randint(8, 20)), "assigned", f"{prose()} {r.choice(['password', 'passwd', 'pwd'])}={r.choice(['', chr(34)])}", after, path, 1))
        elif kind < 10:
            value, form = r.choice([("AKIA" + chars(upper, 16), "aws"), ("ghp_" + chars(both, 36), "github"), ("xoxb-" + chars(both, 24), "slack"), ("sk_live_" + chars(both, 24), "stripe"), ("AIza" + chars(both, 35), "google"), ("eyJ" + chars(both, 20) + "." + chars(both, 40) + "." + chars(both, 30), "jwt"), ("-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(chars(both + "+/", 64) for _ in range(r.randint(1, 25))) + "\n-----END RSA PRIVATE KEY-----", "private-key")])
            out.append((value, form, r.choice([plain, assign]), after, path, 1))
        elif kind >= 20:
            bare = lambda word: r.choice([f"{prose()} | {word} | ", f"{prose()}\t{word}\t", f"{prose()}\n{word}\n", f"{prose()} {word}:\n\n", f"{prose()} {word} ", f"{prose()} --{word} ", f"the {word} is ", f"{prose()} {word} {r.choice(WORDS)} "])
            if kind == 26:
                out.append((r.choice([" ", ", ", " - "]).join(r.choice(WORDS) for _ in range(r.randint(2, 9))), "assigned", assign.rstrip("\"'") + "\"", "\"" + after, path, 0))
            elif kind == 24:
                out.append((chars(hexes, r.choice([32, 40, 64])), "long-run", bare(r.choice(["commit", "sha256", "sha1", "checksum", "etag", "revision", "hash", "digest"])), after, path, 0))
            elif kind == 25:
                value = r.choice(["_", "-", "", "/"]).join(r.choice(WORDS) for _ in range(r.randint(4, 7))) + str(r.randrange(100))
                out.append((value, "long-run", bare(name), after, path, 0))
            else:
                value = r.choice([chars(hexes, r.choice([24, 32, 40, 48, 64])), chars(both + r.choice(["", "+/", "_-"]), r.randint(20, 64))])
                bearer = f"{prose()} {r.choice(['Authorization: ', 'authorization: ', 'header ', ''])}{r.choice(['Bearer', 'Bearer', 'bearer', 'Token'])} "
                out.append((value, "long-run", bearer if kind == 20 else bare(name.replace("_", r.choice(["_", " ", "-"]))), after, path, 1))
        elif kind == 10:
            value = "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12))
            out.append((value, "long-run", f"{prose()} {r.choice(['uuid', 'id', 'request', 'guid'])}{r.choice([' ', '=', ': '])}", after, path, 0))
        elif kind < 13:
            out.append((chars(hexes, r.choice([32, 40, 64])), "long-run", f"{prose()} {r.choice(['commit', 'sha256', 'checksum', 'etag', 'revision', 'hash', 'digest'])}{r.choice([' ', ': ', '='])}", after, path, 0))
        elif kind == 13:
            value = r.choice(["changeme", "your_token_here", "YOUR-API-KEY-HERE", "xxxxxxxxxxxxxxxx", "example_secret", "placeholder1", "********", "test-token-123", "00000000000000000000", "1234567890123456"])
            out.append((value, "assigned", assign, after, path, 0))
        elif kind < 16:
            value = r.choice(["_", "-", "", "/"]).join(r.choice(WORDS) for _ in range(r.randint(3, 6))) + r.choice(["", str(r.randrange(100))])
            assigned = r.random() < 0.5
            out.append((value, "assigned" if assigned else "long-run", assign if assigned else plain, after, path, 0))
        elif kind == 16:
            out.append((chars(string.digits, r.choice([13, 16, 20, 24])), "long-run", f"{prose()} {r.choice(['order', 'card', 'isbn', 'phone', 'number'])} ", after, path, 0))
        elif kind == 17:
            out.append((r.choice(["get_token(request)", "os.environ[TOKEN]", "settings.SECRET_KEY", "${API_TOKEN}", "self.password", "config.get(key)", "request.headers,other", "a,b,c,d,e,f", "string;number"]), "assigned", assign, after, path, 0))
        else:
            value = chars("aeiou", 1) + "".join(r.choice(WORDS)[:4] for _ in range(r.randint(5, 8))) + r.choice(["", chars(string.digits, 1)])
            out.append((value, "long-run", plain, after, path, 0))
    return out


def train(findings: Sequence[tuple[str, str, str, str, str, int]] | None = None, trees: int = 40) -> Forest:
    """A forest from labelled findings (value, kind, before, after, path, label); those made by rule where none are given."""
    rows = list(findings) if findings is not None else labelled_findings()
    x = np.array([features(v, k, b, a, p) for v, k, b, a, p, _ in rows])
    return grow(x, np.array([row[5] for row in rows], float), trees)


def judged(text: str, path: str, forest: Forest, least: float) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, kind, score, whether it counts as a secret) of each candidate of a text."""
    found = candidates(text)
    if not found:
        return []
    x = np.array([features(text[a:b], k, text[max(0, a - BEFORE) : a], text[b : b + AFTER], path) for a, b, k in found])
    return [(a, b, k, float(s), bool(s >= least)) for (a, b, k), s in zip(found, forest.scores(x), strict=True)]


_FOUND = "doc_id long, start long, length long, kind string, value string, score double, is_secret boolean"


def scan(docs: DataFrame, forest: Forest, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, start, length, kind, value, score, is_secret): every candidate of every whole text, places in code points.

    Null and empty texts have none; repeated rows give repeated results; a null path is empty. An empty table gives an empty
    result. Other columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [(doc, a, b - a, k, text[a:b], s, hit) for a, b, k, s, hit in judged(text, path or "", forest, least)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _FOUND.split(", ")])

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    return docs.where(suspect(F.col(text_col))).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), path.alias("path")).transform(text_batches).mapInArrow(each, _FOUND)


def redact(docs: DataFrame, forest: Forest, least: float = 0.5, text_col: str = "text", path_col: str | None = "source", label: str = LABEL) -> DataFrame:
    """``docs`` with ``label`` in place of each secret; all rows and columns stay, and texts without a secret as they are.

    Null texts stay null, a null path is empty, rows that repeat stay, and columns may have any names.
    """
    names = docs.columns
    at = names.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = np.asarray(batch.column(len(names)))
            if flags.any():
                texts = batch.column(at).to_pylist()
                paths = batch.column(len(names) + 1).to_pylist()
                for i in np.flatnonzero(flags):
                    text = texts[i]
                    for a, b, _, _, hit in reversed(judged(text, paths[i] or "", forest, least)):
                        if hit:
                            text = text[:a] + label + text[b:]
                    texts[i] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select(list(range(len(names))))

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    flag, place = fresh(docs, "suspect", "path")
    return docs.select("*", suspect(F.col(text_col)).alias(flag), path.alias(place)).transform(text_batches).mapInArrow(each, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), train())
    return found.select("doc_id", "start", "length", "kind", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")

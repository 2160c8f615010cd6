"""Main text of web pages by a recurrent labeller of blocks.

A page becomes the sequence of its text blocks. A block is read as a vector: embeddings of the names, classes and ids along
its tag path, embeddings of its hashed words, and a few measures. A bidirectional LSTM, in numpy, reads the whole sequence
both ways, so each block is judged in the context of the document, and a logistic layer says whether it is main text.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm.tables import read, text_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Elements by how they are treated.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Content that a browser that runs scripts and plays media does not show as text, that belongs to a form, or that is a drawing.
_RAW = frozenset("script style noscript template iframe textarea title svg annotation annotation-xml object canvas select button audio video xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_PATHS, _WORDS, _MEASURES = 1024, 512, 8
_SHORT = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An open element: its parent, the numbers of its own names, how deep it stands, and the block element that it is in."""

    __slots__ = ("parent", "names", "depth", "element", "name")

    def __init__(self, parent: Node | None, name: str, names: list[int]):
        self.parent, self.name, self.names = parent, name, names
        self.depth = parent.depth + 1 if parent else 0
        self.element = name if name in _BLOCK else parent.element if parent else ""


@dataclass
class Block:
    """Text with single blanks, the element that it begins in, shares of its characters within links, its block element."""

    text: str
    path: Node | None
    linked: float
    element: str


def _number(kind: str, name: str) -> int:
    return zlib.crc32(f"{kind} {name}".encode()) % _PATHS


def _names(element: str, attributes: str) -> list[int]:
    out = [_number("element", element)]
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        out += [_number("part", x) for x in dict.fromkeys(x.lower() for x in _PART.findall(m[2] or m[3] or m[4] or ""))]
    return out


class _Stack:
    """Open elements, with the places of each name and of block elements, so that none is searched for."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def open(self, name: str, names: list[int]) -> None:
        self.places[name].append(len(self.nodes))
        if name in _BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(Node(self.nodes[-1] if self.nodes else None, name, names))

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names, -1 if there is none."""
        return max((self.places[x][-1] for x in names if self.places[x]), default=-1)

    def close(self, at: int) -> None:
        for node in self.nodes[at:]:
            self.places[node.name].pop()
            if node.name in _BLOCK:
                self.blocks.pop()
        del self.nodes[at:]


def blocks(page: str) -> list[Block]:
    """All text of a page outside of scripts, styles, controls, other raw elements and the markup, in page order.

    Elements that are never closed end where HTML ends them: a paragraph at the next block, an item at the next item.
    """
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = 0
    place: Node | None = None

    def end() -> None:
        nonlocal linked, parts
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                size = max(1, sum(map(len, parts)))
                out.append(Block(text, place, min(1.0, linked / size), place.element if place else ""))
            parts, linked = [], 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            if not parts:
                place = stack.nodes[-1] if stack.nodes else None
            parts.append(text)
            if stack.places["a"]:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = m[1] or m[4]
        if name in _BLOCK:
            end()
        if not closing:
            if name in _RAW:
                if not (m[3] or "").rstrip().endswith("/"):
                    found = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                    if not found:
                        at = n
                    else:
                        stop = page.find(">", found.end())
                        at = n if stop < 0 else stop + 1
                continue
            if name in _BLOCK and name != "br":
                if (k := stack.last("p")) >= 0:
                    stack.close(k)
                for other in _CLOSES.get(name, ()):
                    if (k := stack.last(other)) > stack.last(*_HOLDS[name]):
                        stack.close(k)
            if name not in _VOID:
                stack.open(name, _names(name, m[3] or ""))
        elif (k := stack.last(name)) >= 0:
            # the end of an inline element does not reach beyond its block
            if name in _BLOCK or not stack.blocks or k > stack.blocks[-1]:
                stack.close(k)
    end()
    return out


def vectors(found: list[Block]) -> tuple[list[Node | None], list[list[int]], np.ndarray]:
    """Places in the tree, numbers of hashed words, and measures, of each block."""
    words = []
    rows = np.zeros((len(found), _MEASURES), np.float32)
    for i, b in enumerate(found):
        w = b.text.split(" ")
        words.append([zlib.crc32(x.lower().encode()) % _WORDS for x in w])
        n, size = len(w), len(b.text)
        rows[i] = (min(1.5, np.log1p(n) / 4), b.linked, min(1.0, 10 * sum(map(b.text.count, ",;")) / n / 2), float(b.text[-1] in ".!?:\"'»…"), size / n / 10, i / len(found), float(b.element in _SHORT), float(b.element == "p"))
    return [b.path for b in found], words, rows


def _whole(node: Node | None) -> list[int]:
    out = []
    while node is not None:
        out += node.names
        node = node.parent
    return out


def _path_sums(paths: list[Node | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node the sum over its whole path, and the number of names there; each element is added to its parent once."""
    place: dict[int, int] = {}
    nodes: list[Node] = []
    for node in paths:
        while node is not None and id(node) not in place:
            place[id(node)] = len(nodes)
            nodes.append(node)
            node = node.parent
    total, size = np.zeros((len(nodes) + 1, table.shape[1]), np.float32), np.zeros(len(nodes) + 1, np.int64)  # the last row is no element
    if nodes:
        own = np.array([len(x.names) for x in nodes])
        total[:-1] = np.add.reduceat(table[np.array([i for x in nodes for i in x.names])], np.cumsum(own) - own, axis=0)
        size[:-1] = own
        parent = np.array([place[id(x.parent)] if x.parent is not None else len(nodes) for x in nodes])
        depth = np.array([x.depth for x in nodes])
        order = np.argsort(depth, kind="stable")
        edges = np.flatnonzero(np.diff(depth[order])) + 1
        for level in np.split(order, edges)[1:]:
            total[level] += total[parent[level]]
            size[level] += size[parent[level]]
    rows = np.array([place[id(x)] if x is not None else len(nodes) for x in paths], np.int64)
    return total[rows], size[rows]


_P, _W, _H = 24, 8, 24
_IN = _P + _W + _MEASURES


class Labeller:
    """Embeddings, an LSTM for each direction, and the layer above them, which sees the block itself as well."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"path": draw(_PATHS, _P, scale=0.15), "word": draw(_WORDS, _W, scale=0.15), "top": draw(2 * _H + _IN, 1, scale=0.1), "top_bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": draw(_IN, 4 * _H, scale=0.2), f"re_{d}": draw(_H, 4 * _H, scale=0.2), f"bias_{d}": np.concatenate([np.zeros(_H), np.ones(_H), np.zeros(2 * _H)]).astype(np.float32)}

    def inputs(self, pages: list[tuple[list[Node | None], list[list[int]], np.ndarray]], flat: bool = False) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(places, pages, _IN) with zeros after a page's end, which places are blocks; with ``flat``, what was added up where."""
        longest = max(len(m) for _, _, m in pages)
        x, mask = np.zeros((longest, len(pages), _IN), np.float32), np.zeros((longest, len(pages)), bool)
        size = np.array([len(m) for _, _, m in pages])
        t, b = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(pages)), size)
        mask[t, b] = True
        sums = []
        paths = [node for page in pages for node in page[0]]
        found = [_path_sums(paths, self.p["path"])]
        for which in (0, 1) if flat else (1,):
            lists = [_whole(node) for node in paths] if which == 0 else [row for page in pages for row in page[1]]
            n = np.array([len(row) for row in lists])
            numbers = np.array([i for row in lists for i in row], np.int64)
            if flat:
                sums.append((numbers, np.repeat(np.arange(len(lists)), n), (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)[:, None]))
            if which == 1:
                found.append((np.add.reduceat(self.p["word"][numbers], np.cumsum(n) - n, axis=0), n))  # a block has a word
        for (total, n), to in zip(found, (slice(0, _P), slice(_P, _P + _W)), strict=True):
            x[t, b, to] = total / np.sqrt(np.maximum(n, 1)).astype(np.float32)[:, None]
        x[t, b, _P + _W :] = np.concatenate([m for _, _, m in pages])
        return x, mask, (t, b, sums)

    def states(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction; a state passes unchanged over places beyond a page's end."""
        gates_in = x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"]
        h = c = np.zeros((x.shape[1], _H), np.float32)
        out, kept = np.zeros((*x.shape[:2], _H), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = gates_in[t] + h @ self.p[f"re_{d}"]
            i, f, o = (_sigmoid(g[:, k * _H : (k + 1) * _H]) for k in range(3))
            u = np.tanh(g[:, 3 * _H :])
            on = mask[t][:, None]
            c2 = np.where(on, f * c + i * u, c)
            tc = np.tanh(c2)
            h2 = np.where(on, o * tc, h)
            kept.append((t, h, c, i, f, o, u, tc, on))
            h, c = h2, c2
            out[t] = h
        return out, kept

    def both(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Hidden states of both directions, place by place together: (places, pages, 2 * _H)."""
        n, pages = x.shape[:2]
        gates = np.stack([x @ self.p["in_f"] + self.p["bias_f"], (x @ self.p["in_b"] + self.p["bias_b"])[::-1]], 1)
        on = np.stack([mask, mask[::-1]], 1)[..., None]
        again = np.stack([self.p["re_f"], self.p["re_b"]])
        full = mask.all()
        h = c = np.zeros((2, pages, _H), np.float32)
        out = np.zeros((n, 2, pages, _H), np.float32)
        for t in range(n):
            g = gates[t] + h @ again
            ifo = 1 / (1 + np.exp(-np.clip(g[..., : 3 * _H], -30, 30)))
            c2 = ifo[..., _H : 2 * _H] * c + ifo[..., :_H] * np.tanh(g[..., 3 * _H :])
            h2 = ifo[..., 2 * _H :] * np.tanh(c2)
            h, c = (h2, c2) if full else (np.where(on[t], h2, h), np.where(on[t], c2, c))
            out[t] = h
        return np.concatenate([out[:, 0], out[::-1, 1]], 2)

    def scores(self, pages: list) -> list[np.ndarray]:
        """The chance of main text for each block of each page; every page has a block."""
        x, mask, _ = self.inputs(pages)
        both = np.concatenate([self.both(x, mask), x], 2)
        y = _sigmoid(both @ self.p["top"] + self.p["top_bias"])[:, :, 0]
        return [y[: len(m), k] for k, (_, _, m) in enumerate(pages)]

    def gradients(self, pages: list, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask, (t_at, b_at, sums) = self.inputs(pages, flat=True)
        hf, kf = self.states(x, mask, "f")
        hb, kb = self.states(x, mask, "b")
        both = np.concatenate([hf, hb, x], 2)
        y = _sigmoid(both @ self.p["top"] + self.p["top_bias"])[:, :, 0]
        truth = np.zeros_like(y)
        for k, row in enumerate(labels):
            truth[: len(row), k] = row
        error = np.where(mask, y - truth, 0).astype(np.float32)[:, :, None] / mask.sum()
        grad = {"top": np.einsum("tbk,tbo->ko", both, error), "top_bias": error.sum((0, 1))}
        dboth = error * self.p["top"][:, 0]
        dx = dboth[:, :, 2 * _H :].copy()
        for d, kept, dh_all in (("f", kf, dboth[:, :, :_H]), ("b", kb, dboth[:, :, _H : 2 * _H])):
            dgates = np.zeros((*x.shape[:2], 4 * _H), np.float32)
            dre = np.zeros_like(self.p[f"re_{d}"])
            dh = dc = np.zeros((x.shape[1], _H), np.float32)
            for t, h, c, i, f, o, u, tc, on in reversed(kept):
                dh = dh + dh_all[t]
                live = np.where(on, dh, 0)
                dct = np.where(on, dc + live * o * (1 - tc * tc), 0)
                g = np.concatenate([dct * u * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - u * u)], 1)
                dgates[t] = g
                dre += h.T @ g
                dh = np.where(on, 0, dh) + g @ self.p[f"re_{d}"].T
                dc = np.where(on, dct * f, dc)
            grad |= {f"re_{d}": dre, f"in_{d}": np.einsum("tbi,tbg->ig", x, dgates), f"bias_{d}": dgates.sum((0, 1))}
            dx += dgates @ self.p[f"in_{d}"].T
        for (flat, owner, share), name, cut in zip(sums, ("path", "word"), (slice(0, _P), slice(_P, _P + _W)), strict=True):
            grad[name] = np.zeros_like(self.p[name])
            np.add.at(grad[name], flat, (dx[t_at, b_at, cut] * share)[owner])
        return grad


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(pages: list, labels: list[np.ndarray], rounds: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 2) -> Labeller:
    """Adam over pages in random order, with a falling rate."""
    net, rng = Labeller(), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    steps, step = rounds * -(-len(pages) // batch), 0
    for _ in range(rounds):
        order = rng.permutation(len(pages))
        for at in range(0, len(order), batch):
            step += 1
            pick = order[at : at + batch]
            for name, g in net.gradients([pages[i] for i in pick], [labels[i] for i in pick]).items():
                g = np.clip(g, -1, 1)
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                net.p[name] -= rate * (1 - step / (steps + 1)) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return net


# Names that pages give to their parts, and words found in them.
_CONTENT = "article post content entry story text body main single page blog news detail".split()
_PARTS = {
    "menu": ("nav menu navbar navigation breadcrumb breadcrumbs topnav pagination pager links toc skip", "home about contact products blog archive news next previous search accueil kontakt inicio"),
    "header": ("header masthead topbar top banner logo branding site-header hero tagline", "welcome home sign in account subscribe bienvenue willkommen bienvenido"),
    "footer": ("footer bottom copyright colophon legal site-footer credits", "copyright rights reserved privacy terms imprint impressum mentions derechos © ·"),
    "sidebar": ("sidebar side aside widget related recommended popular trending recent more-stories column rail", "related popular recent read more trending tags categories lire mehr"),
    "notice": ("cookie notice consent gdpr banner alert warning message popup modal overlay toast", "cookies accept privacy policy consent we use agree akzeptieren acepter notice"),
    "advert": ("ad ads advert advertisement adbox adsbygoogle sponsor sponsored promo promotion banner-ad", "sponsored advertisement buy now offer sale anzeige publicidad publicité"),
    "form": ("form newsletter subscribe signup login search-form contact-form poll", "email name subscribe send submit password your newsletter"),
    "comments": ("comments comment comment-list reply replies discussion responses respond disqus thread comment-body reactions", "reply says comments ago great post thanks i agree wrote commented kommentar réponse"),
    "share": ("share social sharing follow tools meta byline tags post-meta author-box toolbar", "share tweet facebook email print follow posted by"),
}
_SYLLABLES = "ab an ar ba be bi ca ce chi co da de di do el en er es fa fi ga ge ha he hi il in ing io is ist ja ka ke la le li lo ly ma me mi mo na ne ni no nt on or ou pa pe po qu ra re ri ro sa se si so st ta te th ti to tre tu un ur us va ve vi wa we wi za ze".split()
_GLUE = "the of and to in a is that for it as was with by on are at from this an le la de et des les un une der die das und ist el los que y en".split()
MAIN, OTHER = "\ue000", "\ue001"


def made_page(seed: int) -> str:
    """A page made by rule, for training: its parts in varied markup; each block's text begins with MAIN or OTHER."""
    r = random.Random(seed)
    lexicon = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(150)] + _GLUE * 2

    alike = r.random() < 0.45
    junk = r.random()  # some pages are full of signs, in all of their parts
    if junk < 0.15:
        signs = r.sample(["###", "***", "%%%", "$$$", "!!", "&amp;&amp;", "..", "--", "|"], 3)
        lexicon = [x + r.choice(signs) for x in lexicon]
    if 0.08 < junk < 0.22:
        lexicon = [x.upper() for x in lexicon]
    blank = r.choice([" | ", " - ", " / "]) if 0.18 < junk < 0.32 else " "

    def words(n: int) -> str:
        return blank.join(r.choice(lexicon) for _ in range(n))

    def sentence(lo: int = 3, hi: int = 16) -> str:
        return (words(r.randint(lo, hi)).capitalize() + r.choice([".", ".", ".", "!", "?", ""])).replace("and", "&amp;" if r.random() < 0.1 else "and")

    def prose(most: int = 6) -> str:
        if r.random() < 0.04:
            return blank.join([r.choice(lexicon)] * r.randint(1, 40))
        return " ".join(sentence() for _ in range(r.randint(1, most)))

    def attributes(names: list[str], must: bool = False) -> str:
        if not must and r.random() < 0.3:
            return ""
        name = r.choice(names)
        if r.random() < 0.4:
            name = r.choice([f"{name}-{r.choice(['box', 'wrap', 'list', 'inner', 'area', 'block', str(r.randrange(9))])}", f"site-{name}", f"js-{name}", name.capitalize(), f"{name} clearfix", f"{name}_{r.randrange(99)}", f"c-{name}"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def inline(text: str) -> str:
        if r.random() < 0.2:
            text = f"<{(t := r.choice(['b', 'em', 'strong', 'i', 'span']))}>{text}" + ("" if r.random() < 0.4 else f"</{t}>")
        if r.random() < 0.15:
            text += f' <a href="/x{r.randrange(99)}">{words(2)}</a> {words(3)}'
        return text

    def part(kind: str, must: bool = False) -> str:
        names, phrases = (x.split() for x in _PARTS[kind])
        if alike:  # nothing but the place tells the parts of such a page apart
            phrases = lexicon
        own = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        named = own is not None and r.random() < 0.6
        tag = own if named else r.choice(["div", "div", "div", "section", "ul" if kind == "menu" else "div"])
        attrs = attributes(names, must=not named)
        said = lambda: r.choice([OTHER + words(r.randint(1, 4)), OTHER + " ".join(r.choice(phrases) for _ in range(r.randint(1, 4))), OTHER + r.choice(phrases).capitalize() + " " + sentence(2, 9)])
        link = lambda: f'<a href="/{r.choice(lexicon)}">{said()}</a>'
        if kind == "menu":
            item = "".join(f"<li>{link()}</li>" if r.random() < 0.95 else f"<li>{link()}" for _ in range(r.randint(2, 8)))
            inner = item if tag == "ul" else r.choice([f"<ul>{item}</ul>", " | ".join(link() for _ in range(3)), f"<ul{attributes(['menu', 'list'])}>{item}</ul>"])
        elif kind == "comments":
            one = lambda: f"<{(t := r.choice(['div', 'li', 'article']))}{attributes(names, True)}>{r.choice(['', f'<h4>{said()}</h4>', f'<span>{OTHER}{words(2)}</span>'])}<p>{OTHER}{prose(4)}</p></{t}>"
            inner = r.choice(["", f"<h3>{OTHER}{r.choice(['Comments', 'Replies', 'Discussion'])}</h3>"]) + "".join(one() for _ in range(r.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{said()}</label> <input name=q> <button>Go</button>" + r.choice(["", f"<p>{said()}</p>"])
            inner = inner if tag == "form" else f"<form action=/s>{inner}</form>"
        elif kind == "footer":
            inner = r.choice([f"{OTHER}&copy; {r.choice(lexicon)}.com &middot; {sentence(3, 12)}", f"<p>{OTHER}&copy; 20{r.randrange(10, 30)} {words(3)}</p>" + f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{OTHER}{prose(2)}</p><p>{said()}</p>"])
        elif kind in ("advert", "notice"):
            inner = r.choice([OTHER + sentence(4, 14), f"<p>{OTHER}{prose(2)}</p>", link(), f"<p>{said()}</p><a href=#>{said()}</a>"])
        elif kind == "header":
            inner = r.choice([f"<h1>{OTHER}{words(2)}</h1>", f"<div{attributes(['logo'])}>{link()}</div>", f"<p>{OTHER}{sentence(3, 9)}</p>"]) + r.choice(["", f"<ul><li>{link()}</li><li>{link()}</li></ul>"])
        else:
            inner = r.choice([f"<h3>{said()}</h3>", ""]) + r.choice([f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(r.randint(2, 5)))}</ul>", f"<p>{OTHER}{prose(2)}</p>", f"<p>{said()}</p><p>{OTHER}{sentence()}</p>"])
        return r.choice(["", f"<!-- {words(2)} -->"]) + f"<{tag}{attrs}>{inner}</{tag}>"

    def main() -> str:
        title = MAIN + sentence(3, 10)
        out = r.choice([f"<h1>{title}</h1>", f"<h1{attributes(['title', 'headline', 'entry-title'])}>{title}</h1>", f"<h2>{title}</h2>", "", f"<h1>{title}</h1>"])
        inside = [k for k in ("advert", "share", "sidebar", "form", "notice") if r.random() < 0.12]
        count = r.choice([1, 1, 2, 3, 5, 8, 14])
        for k in range(count):
            kind = r.random()
            if kind < 0.62:
                out += r.choice(["<p>", "<p>", "<p>", f"<p{attributes(['lead', 'text', 'intro'])}>"]) + MAIN + inline(prose()) + r.choice(["</p>", "</p>", "</p>", ""])
            elif kind < 0.7:
                out += f"<p><b>{MAIN}{prose(3)}<br>"
            elif kind < 0.78:
                out += f"<h{(n := r.randint(2, 4))}>{MAIN}{sentence(1, 7)}</h{n}>"
            elif kind < 0.86:
                out += f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{MAIN}{inline(sentence())}" + r.choice(["</li>", "</li>", ""]) for _ in range(r.randint(1, 5))) + f"</{t}>"
            elif kind < 0.92:
                out += f"<blockquote>{r.choice([f'<p>{MAIN}{prose(2)}</p>', MAIN + prose(2)])}</blockquote>"
            elif kind < 0.95:
                out += f"<table><tr><td>{MAIN}{words(2)}</td><td>{MAIN}{words(1)}</td></tr></table>"
            elif kind < 0.97:
                out += f"<pre>{MAIN}{words(8)}</pre>"
            else:
                out += f"<div>{MAIN}{prose(3)}</div>"
            if inside and r.random() < 1 / count:
                out += part(inside.pop(), must=True)
        return out

    article = main()
    holder = r.random()
    if holder < 0.45:
        article = f"<article{attributes(_CONTENT)}>{article}" + "".join(part(k, must=True) for k in ("share", "comments") if r.random() < 0.15) + "</article>"
    elif holder < 0.6:
        article = f"<main{attributes(_CONTENT)}>{article}</main>"
    elif holder < 0.9:
        article = f"<{(t := r.choice(['div', 'section', 'td']))}{attributes(_CONTENT, True)}>{article}</{t}>"
    else:
        article = f"<div>{article}</div>"
    if r.random() < 0.4:
        article = f'<div{attributes(["wrapper", "container", "layout", "row", "grid", "main"])}>{article}</div>'
    before = [part(k) for k in ("notice", "header", "menu", "menu", "advert", "form", "sidebar") if r.random() < 0.45]
    behind = [part(k) for k in ("comments", "share", "sidebar", "advert", "form", "menu", "notice", "footer", "footer") if r.random() < 0.4]
    if r.random() < 0.3:
        r.shuffle(before)
    lead = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(4)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    return lead + "".join(before) + article + "".join(behind) + r.choice(["</body></html>", "</body></html>", ""])


def train(pages: int = 1200, rounds: int = 7, seed: int = 0) -> Labeller:
    """A labeller from pages made by rule; their number is the bound of what it learns from."""
    found, labels = [], []
    for k in range(pages):
        page = blocks(made_page(seed + k))
        if page:
            labels.append(np.array([MAIN in b.text for b in page], np.float32))
            for b in page:
                b.text = b.text.replace(MAIN, "").replace(OTHER, "").strip() or "-"
            found.append(vectors(page))
    return fit(found, labels, rounds)


_TEXTS = "page_id long, url string, text string, n_chars long, n_blocks int, n_main int"


def extract(pages: DataFrame, net: Labeller, least: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", batch: int = 64) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main): the main blocks of every whole page, one to a line.

    Formulas (``math``) are text of their block; what ``_RAW`` lists is none. Null and empty pages, and pages without main
    text, have an empty text. Repeated rows give repeated results, ids and urls
    may be null, an empty table gives an empty result, and other columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for first in range(0, rows.num_rows, 1000):
                part = rows.slice(first, 1000)
                pages_ = [blocks(x) if x else [] for x in part.column(2).to_pylist()]
                order = sorted((i for i, p in enumerate(pages_) if p), key=lambda i: len(pages_[i]))
                texts, mains = [""] * len(pages_), [0] * len(pages_)
                at = 0
                while at < len(order):
                    # pages of like length together; the longest alone bounds what is filled up
                    some = order[at : at + max(1, min(batch, 20_000 // len(pages_[order[min(at + batch, len(order)) - 1]])))]
                    at += len(some)
                    for i, score in zip(some, net.scores([vectors(pages_[i]) for i in some]), strict=True):
                        keep = [b.text for b, s in zip(pages_[i], score, strict=True) if s >= least]
                        texts[i], mains[i] = "\n".join(keep), len(keep)
                counts = [len(p) for p in pages_]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int32()), pa.array(mains, pa.int32())], [x.split()[0] for x in _TEXTS.split(", ")])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col)).transform(text_batches).mapInArrow(each, _TEXTS)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"), train()).select("page_id", "url", "text", "n_chars")

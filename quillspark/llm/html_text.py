"""Main text of web pages by a tree-structured model of the DOM.

A page becomes a tree of its block elements. Each node is content or not: its own evidence (tag, names in class, id and
role, its text's length, links and punctuation, and whether it lies before, in or after the element whose own parts hold the
most unlinked text) gives a potential to either label, each edge one to the pair of parent and
child labels. Sum-product messages go up to the root and down again and leave every node's content marginal; the text of
nodes with a marginal of one half or more is kept. Potentials are trained by the gradient of the labelled trees' likelihood
on pages with labels: labelled_pages() writes a seeded set of them in many layouts, train() takes any other.

Tags are read as HTML's tokenizer does: a quote means something only at the beginning of an attribute's value. Scripts,
styles, comments and the like are no nodes, and controls, media and their parts hold no text. A page is read once, in time
proportional to its length. Character references are decoded, white space inside a block
becomes one space, blocks are joined in page order by one space.

Defined cases. A null or empty page, or one without content, has the text "". Broken markup is taken as it comes: open
elements end with their parent, stray ends are skipped. Text outside any element belongs to the root. Repeated rows are
extracted each. Pages of any length are taken whole. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>|\Z)))?+)*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:^|[\s/\"'])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[^\W\d_]+")
# Elements by what they mean for text.
RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I | re.A) for t in "script style textarea title iframe noembed noframes xmp".split()}  # no elements inside
DROPPED = frozenset("noscript template select button svg object audio video canvas math datalist option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ITEM_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
# What words in class, id and role say.
ROLES = {
    "ad": "ad ads advert advertisement adverts banner promo promotion sponsor sponsored adsense dfp outbrain taboola werbung anzeige anzeigen publicidad anuncio anuncios publicité publicite",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager toc tabs skip menü menue navegación navegacion",
    "header": "header masthead topbar head logo branding brand hero kopfzeile cabecera entête entete",
    "footer": "footer foot colophon copyright legal bottom fusszeile fußzeile impressum pie pied",
    "side": "sidebar side aside widget widgets related recommended more rail complementary teaser seitenleiste lateral",
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe paywall overlay signup message toast warning hinweis aviso avis",
    "comment": "comment comments reply replies respond disqus discussion feedback reviews kommentar kommentare comentario comentarios commentaire commentaires",
    "social": "share sharing social follow tweet facebook twitter",
    "form": "form search login register signin contact suche buscar recherche",
    "content": "article content post entry main story body text articlebody postbody entrycontent artikel inhalt contenido contenu",
    "meta": "byline meta author date dateline timestamp tags category tag",
}
_ROLE = {w: r for r, words in ROLES.items() for w in words.split()}
OUTER = frozenset("nav header footer aside form".split())
EDGES = 3  # plain, boilerplate child, content child


class Dom:
    """A page's block elements in document order: parent, tag, roles, own text; and its text pieces in order, each with its node."""

    __slots__ = ("parent", "tag", "roles", "text", "linked", "pieces")

    def __init__(self) -> None:
        self.parent, self.tag, self.roles, self.text, self.linked = [-1], ["root"], [frozenset()], [0], [0]
        self.pieces: list[tuple[int, str]] = []


@functools.lru_cache(maxsize=50_000)
def _roles(attributes: str) -> frozenset[str]:
    found = set()
    for m in _NAMES.finditer(attributes):
        for w in _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()):
            if w in _ROLE:
                found.add(_ROLE[w])
    return frozenset(found)


class _Reader:
    """Builds a Dom from tokens: the open elements, inline ones too, each with the node that its text belongs to."""

    def __init__(self) -> None:
        self.dom = Dom()
        self.stack: list[tuple[str, int]] = [("root", 0)]
        self.open: Counter[str] = Counter()
        self.silent = 0  # open elements whose text is dropped
        self.words: list[str] = []

    def flush(self) -> None:
        if self.words:
            t = _SPACE.sub(" ", "".join(self.words)).strip()
            self.words.clear()
            if t:
                self.dom.pieces.append((self.stack[-1][1], t))

    def leave(self, depth: int) -> None:
        if any(t not in INLINE for t, _ in self.stack[depth:]):
            self.flush()
        for t, _ in self.stack[depth:]:
            self.open[t] -= 1
            self.silent -= t in DROPPED
        del self.stack[depth:]

    def text(self, raw: str) -> None:
        if raw and not self.silent:
            self.words.append(html.unescape(raw) if "&" in raw else raw)
            node, n = self.stack[-1][1], len(raw.strip())
            self.dom.text[node] += n
            if self.open["a"] > 0:
                self.dom.linked[node] += n

    def back_to(self, tags: tuple[str, ...], stops: Callable[[str], bool]) -> None:
        """Leave the innermost open element of these tags, unless one that stops the search lies within."""
        if any(self.open[t] > 0 for t in tags):
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth][0] in tags:
                    self.leave(depth)
                    return
                if stops(self.stack[depth][0]):
                    return

    def end(self, tag: str) -> None:
        self.back_to((tag,), (lambda t: t not in INLINE) if tag in INLINE else (lambda t: False))

    def begin(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr") and not self.silent:
                self.words.append(" ")
            return
        if tag in ITEMS:
            self.back_to(ITEMS[tag], lambda t: t in ITEM_STOPS[tag])
        if tag in DROPPED:
            if not attributes.endswith("/"):
                self.push(tag, self.stack[-1][1])
                self.silent += 1
            return
        if tag in INLINE:
            self.push(tag, self.stack[-1][1])
            return
        if self.silent:
            self.push(tag, self.stack[-1][1])
            return
        if tag in ENDS_P:
            self.back_to(("p",), lambda t: t not in INLINE)
        self.flush()
        if attributes.endswith("/"):
            return
        dom = self.dom
        dom.parent.append(self.stack[-1][1])
        dom.tag.append(tag)
        dom.roles.append(_roles(attributes) if attributes else frozenset())
        dom.text.append(0)
        dom.linked.append(0)
        self.push(tag, len(dom.parent) - 1)

    def push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.open[tag] += 1


def parse(page: str) -> Dom:
    reader, at = _Reader(), 0
    while m := _TOKEN.search(page, at):
        reader.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            reader.end(tag)
        elif tag in RAW:
            if not m[3].endswith("/"):
                close = RAW[tag].search(page, at)
                stop = page.find(">", close.end()) if close else -1
                at = len(page) if stop < 0 else stop + 1
        elif tag != "head":  # its own elements are dropped; a page may never end it
            reader.begin(tag, m[3])
    reader.text(page[at:])
    reader.flush()
    return reader.dom


# --- the model -------------------------------------------------------------------------------

_TAGS = ("root", "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "blockquote", "pre", "table", "tr", "td", "th", "dl", "dt", "dd", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "fieldset", "details", "summary", "address", "inner", "other")
ZONES = ("before", "in", "within", "after")  # of the anchor: in it or its lists and the like, within a container inside it
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMED = [*(f"tag:{t}" for t in _TAGS), *(f"role:{r}" for r in ROLES), *(f"long:{k}" for k in range(5)), "links:some", "links:most", "stop", "alone", *(f"{z}:{k}" for z in ZONES for k in range(5)), *(f"{z}:links" for z in ZONES), *(f"{z}:heading" for z in ZONES), "anchor"]
_AT = {f: i for i, f in enumerate(_NAMED)}
UNARY = len(_NAMED)


@functools.lru_cache(maxsize=200_000)
def _evidence(tag: str, roles: frozenset[str], long: int, links: int, stop: bool, zone: str, anchor: bool) -> tuple[int, ...]:
    named = [f"tag:{tag if tag in _TAGS else 'other'}", *(f"role:{r}" for r in sorted(roles)), f"long:{long}", f"{zone}:{long}"]
    if links:
        named.append(("links:some", "links:most")[links - 1])
        named.append(f"{zone}:links")
    if stop:
        named.append("stop")
    if long and not roles:
        named.append("alone")
    if tag in _HEADINGS:
        named.append(f"{zone}:heading")
    if anchor:
        named.append("anchor")
    return tuple(_AT[f] for f in named)


def _within(dom: Dom) -> list[bool]:
    """Whether each node is, or lies in, an element that names itself content."""
    out: list[bool] = []
    for parent, tag, roles in zip(dom.parent, dom.tag, dom.roles, strict=True):
        out.append(tag in ("article", "main") or "content" in roles or parent >= 0 and out[parent])
    return out


def anchor(dom: Dom, within: list[bool]) -> tuple[int, int]:
    """The node whose own text and children's hold the most unlinked characters, and the first node behind its subtree. Elements
    that name themselves content come before others if they hold text at all."""
    sums = [0] * len(dom.tag)
    for i, (p, n, linked) in enumerate(zip(dom.parent, dom.text, dom.linked, strict=True)):
        plain = n - linked
        if plain > (0 if within[i] else 25):
            sums[i] += plain
            if p >= 0 and dom.tag[i] in _BLOCKS:
                sums[p] += plain + 1
    best = max(range(len(sums)), key=lambda i: (within[i] and sums[i] > 0, sums[i]))
    if sums[best] and dom.tag[best] in _BLOCKS and dom.parent[best] >= 0:
        best = dom.parent[best]
    end = best + 1
    while end < len(dom.parent) and dom.parent[end] >= best:  # document order: a subtree is a range
        end += 1
    return best, end


_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre dl dt dd figure figcaption".split())


def evidence(dom: Dom) -> tuple[list[tuple[int, ...]], list[int]]:
    """Each node's features and its edge's kind."""
    stops = [False] * len(dom.tag)
    for node, t in dom.pieces:
        stops[node] |= t[-1] in ".!?"
    within = _within(dom)
    first, end = anchor(dom, within)
    found, kinds, near = [], [], []
    for i, (parent, tag, roles, n, linked, stop) in enumerate(zip(dom.parent, dom.tag, dom.roles, dom.text, dom.linked, stops, strict=True)):
        article = tag in ("article", "main") or "content" in roles
        near.append(i == first or parent == first or parent >= 0 and near[parent] and dom.tag[parent] in _BLOCKS)
        zone = "before" if i < first else "after" if i >= end else "in" if near[i] else "within"
        if tag in ("header", "address") and parent >= 0 and within[parent]:
            tag, roles = "inner", roles - {"header"}  # an article's own head, not the page's
        long = 0 if n == 0 else 1 if n <= 25 else 2 if n <= 80 else 3 if n <= 300 else 4
        links = 0 if not linked else 2 if 2 * linked >= n else 1
        found.append(_evidence(tag, roles, long, links, stop, zone, i == first))
        kinds.append(1 if tag in OUTER or roles and roles - {"content", "meta"} and "content" not in roles else 2 if article else 0)
    return found, kinds


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def _plus(a: float, b: float) -> float:
    """log(e^a + e^b)"""
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def marginals(found: list[tuple[int, ...]], kinds: list[int], parent: list[int], unary: list[float], edge: list[list[float]], pairs: bool = False):
    """Content marginals by sum-product; with pairs also, for each node but the root, the four joint marginals with its parent."""
    n = len(parent)
    own = [sum([unary[f] for f in fs]) for fs in found]  # log-potential of content; of the other label 0
    up1, up0 = own[:], [0.0] * n
    to1, to0 = [0.0] * n, [0.0] * n  # messages to the parent
    for i in range(n - 1, 0, -1):
        e = edge[kinds[i]]
        to0[i], to1[i] = _plus(e[0] + up0[i], e[1] + up1[i]), _plus(e[2] + up0[i], e[3] + up1[i])
        up0[parent[i]] += to0[i]
        up1[parent[i]] += to1[i]
    all0, all1 = up0[:], up1[:]
    joint = []
    for i in range(1, n):
        e, p = edge[kinds[i]], parent[i]
        out0, out1 = all0[p] - to0[i], all1[p] - to1[i]
        if pairs:
            four = [out0 + e[0] + up0[i], out0 + e[1] + up1[i], out1 + e[2] + up0[i], out1 + e[3] + up1[i]]
            top = max(four)
            weights = [math.exp(x - top) for x in four]
            total = sum(weights)
            joint.append([w / total for w in weights])
        all0[i] = up0[i] + _plus(out0 + e[0], out1 + e[2])
        all1[i] = up1[i] + _plus(out0 + e[1], out1 + e[3])
    content = [_sigmoid(b - a) for a, b in zip(all0, all1, strict=True)]
    return (content, joint) if pairs else content


def train(pages: list[tuple[str, set[str]]], rounds: int = 80, rate: float = 0.5) -> tuple[list[float], list[list[float]]]:
    """pages: html and the set of its content blocks' texts. Gradient ascent on the labelled trees' likelihood."""
    data = []
    for page, blocks in pages:
        dom = parse(page)
        label = [0] * len(dom.tag)
        for node, t in dom.pieces:
            label[node] = int(t in blocks)
        for i in range(len(label) - 1, 0, -1):  # an element without text of its own is content if a child is
            if label[i] and dom.text[dom.parent[i]] == 0:
                label[dom.parent[i]] = 1
        data.append((*evidence(dom), dom.parent, label))
    unary, edge = np.zeros(UNARY), np.zeros((EDGES, 4))
    grown_u, grown_e = np.full(UNARY, 1e-3), np.full((EDGES, 4), 1e-3)
    total = sum(len(d[3]) for d in data)
    for _ in range(rounds):
        gu, ge = -0.002 * unary, -0.002 * edge
        u, e = unary.tolist(), edge.tolist()
        for found, kinds, parent, label in data:
            content, joint = marginals(found, kinds, parent, u, e, pairs=True)
            for fs, p, y in zip(found, content, label, strict=True):
                for f in fs:
                    gu[f] += (y - p) / total
            for i, four in enumerate(joint, 1):
                k = kinds[i]
                ge[k, 2 * label[parent[i]] + label[i]] += 1 / total
                ge[k] -= np.array(four) / total
        grown_u += gu * gu
        grown_e += ge * ge
        unary += rate * gu / np.sqrt(grown_u)
        edge += rate * ge / np.sqrt(grown_e)
    return unary.tolist(), edge.tolist()


def labelled_pages(n: int = 240, seed: int = 5) -> list[tuple[str, set[str]]]:
    """Seeded pages in many layouts, with the texts of their content blocks."""
    rng = random.Random(seed)
    syllables = "ba ke lo mi nu ra se ti vo zu".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentence(a: int, b: int) -> str:
        t = words(a, b)
        return t[0].upper() + t[1:] + rng.choice(".....!?")

    def links(a: int, b: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 2)}</a></li>' for _ in range(rng.randint(a, b)))

    def one() -> tuple[str, set[str]]:
        good: set[str] = set()

        def keep(text: str) -> str:
            good.add(text)
            return text

        def block() -> str:
            kind = rng.random()
            if kind < 0.68:
                return f"<p>{keep(sentence(3, 90))}</p>"
            if kind < 0.76:
                return f"<p>{keep(words(1, 4))}</p>"
            if kind < 0.84:
                return f"<h{(k := rng.randint(2, 4))}>{keep(words(2, 7))}</h{k}>"
            if kind < 0.92:
                return "<ul>" + "".join(f"<li>{keep(sentence(3, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            if kind < 0.96:
                return f"<blockquote>{keep(sentence(6, 30))}</blockquote>"
            return f"<div>{keep(sentence(10, 50))}</div>"

        bare = rng.random() < 0.4  # nothing but structure tells what is what

        def outer(name: str) -> str:
            wrap, role = {"nav": ("nav", "menu"), "header": ("header", "site-header"), "footer": ("footer", "footer"), "aside": ("aside", "sidebar"), "form": ("form", "search-form"), "ad": ("div", rng.choice(("ad", "advert", "banner", "sponsored"))), "notice": ("div", rng.choice(("cookie-notice", "newsletter", "popup", "consent", "alert"))), "comment": (rng.choice(("section", "div")), rng.choice(("comments", "comment-list", "replies"))), "social": ("div", rng.choice(("share", "social"))), "related": ("div", rng.choice(("related", "widget", "recommended")))}[name]
            tag = wrap if rng.random() < 0.6 else "div"
            named = f' class="{role}"' if tag == "div" or rng.random() < 0.4 else ""
            if bare:
                tag, named = rng.choice((("div", ""), ("div", f' class="{words(1, 1)}"'), ("div", f' id="{words(1, 1)}"')))
            inner = {
                "nav": lambda: f"<ul>{links(3, 8)}</ul>",
                "header": lambda: rng.choice((f"<h1>{words(1, 3)}</h1>", f"<div>{words(1, 3)}</div>", f"<p>{sentence(2, 8)}</p>")) + (f"<ul>{links(2, 5)}</ul>" if rng.random() < 0.4 else ""),
                "footer": lambda: rng.choice((f"&copy; {words(1, 2)} &middot; {sentence(4, 10)}", f"<p>{sentence(4, 20)}</p>", f"<ul>{links(2, 6)}</ul><p>{words(2, 6)}</p>")),
                "aside": lambda: rng.choice((f"<h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul>", f"<p>{sentence(5, 40)}</p>")),
                "form": lambda: f"<label>{words(1, 3)}</label><input name=q><p>{sentence(3, 12)}</p><button>{words(1, 1)}</button>",
                "ad": lambda: rng.choice((sentence(4, 25), f"<p>{sentence(4, 40)}</p>", f'<a href="/b">{words(2, 6)}</a>')),
                "notice": lambda: rng.choice((sentence(5, 25), f"<p>{sentence(5, 40)}</p>")),
                "comment": lambda: "".join(rng.choice((f'<div class="comment"><p>{sentence(3, 40)}</p></div>', f"<p>{sentence(3, 40)}</p>", f"<ul><li><p>{sentence(4, 30)}</p></li></ul>")) for _ in range(rng.randint(1, 4))),
                "social": lambda: f"<ul>{links(2, 4)}</ul>",
                "related": lambda: f"<h3>{words(1, 3)}</h3>" + rng.choice((f"<ul>{links(2, 6)}</ul>", f"<p>{sentence(4, 30)}</p>")),
            }[name]()
            return f"<{tag}{named}>{inner}</{tag}>"

        title = keep(words(3, 10))
        head = f"<h1>{title}</h1>" if rng.random() < 0.8 else f"<header><h1>{title}</h1></header>" if not bare else f"<div><h1>{title}</h1></div>"
        if not bare and rng.random() < 0.2:  # hardly anything: less than around it
            core = [head, f"<p>{keep(rng.choice((words(1, 3), title, sentence(1, 4))))}</p>"]
        else:
            core = [head] + [block() for _ in range(rng.randint(2 if bare else 1, 12))]
        for name in ("ad", "social", "related", "notice", "form"):
            if rng.random() < 0.15 and not bare:
                core.insert(rng.randint(1, len(core)), outer(name))
        shell = rng.choice(("<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="post-body"><div>{}</div></div>', '<section class="entry">{}</section>', "<article><div>{}</div></article>", '<div id="main">{}</div>'))
        if bare:
            shell = rng.choice(("<div>{}</div>", "{}", "<div><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<table><tr><td><div>{}</div></td></tr></table>", "<section>{}</section>", "<center>{}</center>"))
        before = [outer(x) for x in ("notice", "header", "nav", "ad") if rng.random() < 0.6]
        after = [outer(x) for x in ("comment", "aside", "related", "form", "social", "ad", "footer") if rng.random() < 0.5]
        rng.shuffle(before)
        page = "".join([*before, shell.format("".join(core)), *after])
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{page}</body></html>", good

    return [one() for _ in range(n)]


@functools.lru_cache(maxsize=1)
def default_model() -> tuple[list[float], list[list[float]]]:
    return train(labelled_pages())


def main_blocks(page: str, model: tuple[list[float], list[list[float]]]) -> list[str]:
    dom = parse(page)
    if not dom.pieces:
        return []
    content = marginals(*evidence(dom), dom.parent, *model)
    return [t for node, t in dom.pieces if content[node] >= 0.5]


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: tuple[list[float], list[list[float]]] | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of every row."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [main_blocks(p, model) if p else [] for p in batch.column(2).to_pylist()]
            texts = [" ".join(b) for b in blocks]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in blocks], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    own = bounded(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")

"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of block elements.  Boosted trees score each node from its
subtree's density, attribute tokens, depth and siblings; a hierarchical decoding then picks
the most likely labels among those in which no node outside the main text has a descendant
inside it.  The trees are fitted here, on ``TRAIN_PAGES`` generated pages whose parts are
known, because no table marks main text; pages of the corpus are never fitted on.

Results for odd input: a null html counts as empty; a page without main text gives the empty
text.  Broken markup is read with implied ends, and an end without a start is skipped.
Attributes are read as HTML says: a quote inside a bare value is part of it.  A quoted value
without an end ends with its tag; a tag without an end is dropped with what follows.
Reading takes time in proportion to a page, however it is broken.
Pages are read one by one, so repeated rows get equal results; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parlance.llm._common import in_batches, release, slices, table

TRAIN_PAGES = 800
TREES, DEPTH, RATE, BINS = 40, 4, 0.3, 24
SEED = 11

_NAME = re.compile(r"[^\s/>]+")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE) for name in ("script", "style", "template", "textarea", "title", "iframe")}
_TOKEN = re.compile(r"[a-z]+")

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(_ENDS)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math annotation maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements that end with the one that opens (by name), unless one of the others stands between.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}

#: Groups of tokens in class, id and role attributes.
GROUPS = {
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs toc pagination pager tabs",
    "foot": "footer foot bottom copyright colophon legal contentinfo",
    "head": "header head masthead topbar top logo branding",
    "side": "sidebar side aside rail related recommended widget widgets complementary popular trending more",
    "talk": "comment comments commentlist reply replies respond discussion discussions disqus reader readers thread feedback",
    "note": "cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe subscription paywall privacy",
    "form": "form login signin signup search register contact",
    "share": "share sharing social follow tags tag meta byline author",
    "main": "content article post entry story main body text page blog news copy",
}
_GROUP_OF = {t: k for k, names in enumerate(GROUPS.values()) for t in names.split()}
_TAGS = ("p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "td", "h1", "h2", "blockquote", "pre", "figure", "body", "button", "select", "noscript", "svg", "dialog")
_TAG_NO = {t: k for k, t in enumerate(_TAGS)}
_ABOVE = ("article", "main", "nav", "aside", "footer", "header", "form")
N_FEATURES = len(_TAGS) + 2 * len(GROUPS) + len(_ABOVE) + 16


class Node:
    __slots__ = ("tag", "parent", "kids", "parts", "groups", "own", "links", "paras", "text", "depth", "order", "label", "h1")

    def __init__(self, tag: str, parent: Node | None, groups: tuple[int, ...] = ()):
        self.tag, self.parent, self.groups = tag, parent, groups
        self.kids: list[Node] = []
        self.parts: list[str | Node] = []
        self.own = self.links = self.paras = self.text = self.h1 = 0
        self.depth = parent.depth + 1 if parent else 0
        self.label: str | None = None


def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from behind its name, and where the tag has ended; a quote that nothing closes ends with the tag."""
    found: dict[str, str] = {}
    n = len(source)
    while True:
        at = _GAP.match(source, at).end()
        if at >= n or source[at] == ">":
            return found, min(at + 1, n)
        key = _KEY.match(source, at)
        at, value = key.end(), ""
        eq = _EQUALS.match(source, at)
        if eq:
            at = eq.end()
            quote = source[at : at + 1]
            if quote in ("'", '"') and quote:
                end = source.find(quote, at + 1)
                if end < 0:
                    end = source.find(">", at)
                    return found, (end if end >= 0 else n - 1) + 1
                value, at = source[at + 1 : end], end + 1
            else:
                bare = _BARE.match(source, at)
                value, at = bare.group(), bare.end()
        found.setdefault(key.group().lower(), value)


def parse(source: str) -> Node:
    """The tree of block elements; inline elements leave only their text."""
    root = Node("body", None)
    stack: list[Node] = [root]
    open_: dict[str, int] = {}  # how many elements of a name are open, so that an end without a start is known at once
    links, at, n, last = 0, 0, len(source), source.rfind(">")

    def add(text: str) -> None:
        if "&" in text:
            text = html_lib.unescape(text)
        top = stack[-1]
        top.parts.append(text)
        size = len(text) - text.count(" ")
        top.own += size
        if links:
            top.links += size

    def close(k: int) -> None:
        for node in stack[k:]:
            open_[node.tag] -= 1
        del stack[k:]

    def close_above(names: tuple[str, ...], walls: tuple[str, ...]) -> None:
        if any(open_.get(x) for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in walls:
                    return
                if stack[k].tag in names:
                    return close(k)

    while at < n:
        less = source.find("<", at)
        if less < 0:
            add(source[at:])
            break
        nxt = source[less + 1 : less + 2]
        closing = nxt == "/"
        head = source[less + 2 : less + 3] if closing else nxt
        if not (head.isascii() and head.isalpha()):
            if nxt == "!" or nxt == "?" or closing and head:
                if less > at:
                    add(source[at:less])
                if source.startswith("<!--", less):
                    end = source.find("-->", less + 2)
                    at = end + 3 if end >= 0 else n
                elif source.startswith("<![CDATA[", less) and (end := source.find("]]>", less)) >= 0:
                    at = end + 3
                else:
                    at = source.find(">", less) + 1 or n
            else:  # a sign in the text
                add(source[at : less + 1])
                at = less + 1
            continue
        if less > at:
            add(source[at:less])
        if less > last:
            break  # nothing ends this tag
        name = _NAME.match(source, less + 1 + closing)
        end = name.end()
        if source[end] == ">":
            attributes, at = {}, end + 1
        else:
            attributes, at = _attributes(source, end)
        tag = name.group().lower()
        if not closing and tag in RAW and source[at - 2] != "/":
            stop = _ENDS[tag].search(source, at)
            at = stop.end() if stop else n
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE or tag in ("html", "head", "body"):
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].parts.append(" ")
            continue
        if closing:
            close_above((tag,), ())
            links = 0 if tag in CLOSES_P else links
            continue
        if tag in CLOSES_P:
            close_above(("p",), ("td", "th", "table", "li", "div", "section", "article"))
        elif tag in _CLOSES:
            close_above(*_CLOSES[tag])
        groups, label = (), None
        if attributes:
            groups = tuple({_GROUP_OF[t] for k in ("class", "id", "role") for t in _TOKEN.findall(attributes.get(k, "").lower()) if t in _GROUP_OF})
            label = attributes.get("data-truth")
        node = Node(tag, stack[-1], groups)
        node.label = label
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes in page order, with the sums over their subtrees."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.order = len(out)
        out.append(node)
        todo += reversed(node.kids)
    for node in reversed(out):
        node.text += node.own
        node.paras += node.tag == "p" and node.own > 40
        node.h1 += node.tag == "h1"
        if node.parent is not None:
            p = node.parent
            p.text += node.text
            p.links += node.links
            p.paras += node.paras
            p.h1 += node.h1
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node of one page."""
    x = np.zeros((len(nodes), N_FEATURES), dtype=np.float32)
    total = max(1, nodes[0].text)
    n_tags, n_groups, n_above = len(_TAGS), len(GROUPS), len(_ABOVE)
    above: list[tuple[frozenset, frozenset]] = []
    before, seen = [], 0
    for node in nodes:
        before.append(seen)
        seen += node.own
    at = n_tags + 2 * n_groups + n_above
    for k, node in enumerate(nodes):
        p = node.parent
        tags, groups = (above[p.order][0] | {p.tag}, above[p.order][1] | set(p.groups)) if p else (frozenset(), frozenset())
        above.append((tags, groups))
        row = x[k]
        if node.tag in _TAG_NO:
            row[_TAG_NO[node.tag]] = 1
        for g in node.groups:
            row[n_tags + g] = 1
        for g in groups:
            row[n_tags + n_groups + g] = 1
        for j, t in enumerate(_ABOVE):
            row[n_tags + 2 * n_groups + j] = t in tags
        size = len(p.kids) if p else 1
        row[at : at + 16] = (
            np.log1p(node.text), node.links / max(1, node.text), node.text / total, node.own / max(1, node.text), np.log1p(node.own), node.depth, len(node.kids),
            np.log1p(node.paras), node.text / max(1, len(node.kids)), size, (p.text / total) if p else 1.0, node.text / max(1, p.text if p else node.text),
            before[k] / total, node.h1, (p.paras if p else node.paras), (p.links / max(1, p.text)) if p else 0.0,
        )
    return x


class Boosted:
    """Gradient-boosted trees for two classes, grown on histograms, in arrays."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.n, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score, width = np.full(len(y), self.base), self.bins + 1
        self.feature = np.zeros((self.n, 2**self.depth - 1), dtype=np.int64)
        self.cut = np.full((self.n, 2**self.depth - 1), np.inf, dtype=np.float32)
        self.leaf = np.zeros((self.n, 2**self.depth))
        for t in range(self.n):
            p = 1 / (1 + np.exp(-score))
            g, h, node = y - p, p * (1 - p), np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, k = 2**level - 1, 2**level
                gain, best_cut, best_f = np.zeros(k), np.full(k, np.inf), np.zeros(k, dtype=np.int64)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    at = node * width + binned[:, j]
                    sg = np.bincount(at, weights=g, minlength=k * width).reshape(k, width)
                    sh = np.bincount(at, weights=h, minlength=k * width).reshape(k, width)
                    lg, lh, tg, th = sg.cumsum(1), sh.cumsum(1), sg.sum(1)[:, None], sh.sum(1)[:, None]
                    value = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
                    value = value[:, : len(c)]
                    b = value.argmax(1)
                    better = value[np.arange(k), b] > gain + 1e-9
                    gain[better], best_f[better], best_cut[better] = value[np.arange(k), b][better], j, c[b][better]
                self.feature[t, first : first + k], self.cut[t, first : first + k] = best_f, best_cut
                node = 2 * node + (x[np.arange(len(y)), best_f[node]] > best_cut[node].astype(np.float32))
            sg, sh = np.bincount(node, weights=g, minlength=2**self.depth), np.bincount(node, weights=h, minlength=2**self.depth)
            self.leaf[t] = self.rate * sg / (sh + 1)
            score += self.leaf[t][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.n):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = node + 2**level - 1
                node = 2 * node + (x[rows, self.feature[t][at]] > self.cut[t][at])
            out += self.leaf[t][node]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labels in which a node inside the main text has no ancestor outside it."""
    inside = -np.logaddexp(0, -odds)
    outside = -np.logaddexp(0, odds)
    for k in range(len(nodes) - 1, 0, -1):
        p = nodes[k].parent.order
        inside[p] += max(inside[k], outside[k])
        outside[p] += outside[k]
    chosen: list[bool] = []
    for k, node in enumerate(nodes):
        chosen.append((node.parent is None or chosen[node.parent.order]) and bool(inside[k] > outside[k]))
    return chosen


def _text(root: Node, chosen: list[bool]) -> str:
    out: list[str] = []
    todo: list[str | Node] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif chosen[x.order]:
            out.append(" ")
            todo.append(" ")
            todo += reversed(x.parts)
        else:
            out.append(" ")
    return " ".join("".join(out).split())


# --- generated pages ---------------------------------------------------------------


def _page(rng: np.random.Generator) -> str:
    """A page whose parts carry ``data-truth``."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p

    def words(a: int, b: int) -> str:
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(int(rng.integers(a, b)))) + pick(".", "", "!", ".")

    def attr(names: str, p: float = 0.85) -> str:
        if not chance(p):
            return ""
        name = pick(*names.split())
        return f' {pick("class", "id", "class")}="{pick(name, name + "-" + pick("wrap", "box", "inner", "1"), "x-" + name, name + " block")}"'

    out, truth = ' data-truth="out"', ' data-truth="in"'
    links = lambda n: "".join(f'<li><a href="#">{words(1, 4)}</a></li>' for _ in range(n))
    para = lambda: f"<p>{pick('', '<b>')}{words(4, 90)}" + pick("</p>", "</p>", "<br></p>", "")

    def junk() -> str:
        kind = int(rng.integers(15))
        n = int(rng.integers(2, 9))
        if kind == 0:
            return f"<nav{out}{attr('menu nav', 0.3)}><ul>{links(n)}</ul></nav>"
        if kind == 1:
            return f"<div{out}{attr('menu nav navbar breadcrumb navigation', 1)}>{pick(f'<ul>{links(n)}</ul>', ''.join(f'<a href=#>{words(1, 3)}</a> ' for _ in range(n)))}</div>"
        if kind == 2:
            return f"<div{out}{attr('ad ads advert sponsored promo banner advertisement', 1)}>{pick(words(4, 40), para())}</div>"
        if kind == 3:
            return f"<aside{out}{attr('sidebar related', 0.5)}>{pick(f'<h3>{words(1, 4)}</h3><ul>{links(n)}</ul>', para(), para() + para())}</aside>"
        if kind == 4:
            return f"<div{out}{attr('sidebar related widget recommended rail', 1)}><h3>{words(1, 4)}</h3>{pick(f'<ul>{links(n)}</ul>', para())}</div>"
        if kind == 5:
            return f"<form{out}{attr('login search newsletter', 0.5)}><label>{words(1, 4)}</label><input name=q>{pick('', para())}</form>"
        if kind == 6:
            return f"<{(t := pick('section', 'div', 'ol', 'ul'))}{out}{attr('comments comment discussion replies disqus', 1)}>" + "".join(
                pick(f"<div{attr('comment reply', 0.6)}>{para()}</div>", f"<li>{words(3, 40)}</li>", para(), f"<article>{para()}</article>") for _ in range(n)
            ) + f"</{t}>"
        if kind == 7:
            return f"<{(t := pick('div', 'section', 'p', 'dialog'))}{out}{attr('cookie consent notice gdpr popup newsletter alert', 1)}>{words(5, 50)}</{t}>"
        if kind == 8:
            return f"<div{out}{attr('share social tags byline', 1)}>{words(1, 8)}</div>"
        if kind == 9:
            return f"<footer{out}>&copy; {words(4, 40)}</footer>"
        if kind == 10:
            return f"<header{out}{attr('masthead header', 0.4)}>{pick(f'<h2>{words(1, 5)}</h2>', words(2, 12))}{pick('', f'<ul>{links(n)}</ul>')}</header>"
        if kind == 11:
            return f"<div{out}{attr('footer copyright bottom legal', 1)}>{words(4, 40)}</div>"
        if kind == 12:
            return f"<noscript{out}>{words(3, 20)}</noscript>"
        if kind == 13:
            return f"<div{out}{attr('search form login', 0.5)}>{pick('<button>' + words(1, 3) + '</button>', '<select>' + ''.join(f'<option>{words(1, 2)}' for _ in range(n)) + '</select>')}</div>"
        return f"<div{out}{attr('header masthead topbar', 1)}>{words(2, 12)}</div>"

    def block() -> str:
        kind = int(rng.integers(14))
        if kind == 0:
            return "<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
        if kind == 1:
            return f"<h2>{words(2, 8)}</h2>"
        if kind == 2:
            return f"<blockquote>{pick(para(), words(5, 40))}</blockquote>"
        if kind == 3:
            return "<table>" + "".join(f"<tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr>" for _ in range(3)) + "</table>"
        if kind == 4:
            return f"<figure><figcaption>{words(3, 15)}</figcaption></figure>"
        if kind == 5:
            return f"<pre>{words(4, 20)}</pre>"
        if kind == 6:
            return f"<div>{pick(para() + para(), words(5, 60))}</div>"
        if kind == 7:
            return f"<section><h3>{words(1, 5)}</h3>{para()}{para()}</section>"
        if kind == 8:
            return f"<p>{words(3, 20)} <math><mi>{words(1, 2)}</mi><mo>=</mo><mn>42</mn></math> {words(3, 20)}</p>"
        return para()

    tag = pick("article", "article", "main", "div", "div", "section", "div")
    need = 0.3 if tag in ("article", "main") else 0.9
    title = pick(f"<h1>{words(3, 12)}</h1>", f"<header><h1>{words(3, 12)}</h1></header>", "", f"<h1>{words(3, 12)}</h1>")
    body = [title, *(block() for _ in range(int(rng.integers(1, 14))))]
    if chance(0.35):
        body.insert(int(rng.integers(1, len(body) + 1)), junk())
    article = f"<{tag}{truth}{attr('content article post entry story main body text post-content entry-content', need)}>{''.join(body)}</{tag}>"
    around = [junk() for _ in range(int(rng.integers(0, 5)))], [junk() for _ in range(int(rng.integers(0, 5)))]
    inner = "".join(around[0]) + article + "".join(around[1])
    if chance(0.4):
        inner = f"<div{attr('page wrapper container site', 0.7)}>{inner}</div>"
    foot = f"<footer{out}>&copy; {words(4, 40)}</footer>" if chance(0.6) else ""
    top = f"<nav{out}><ul>{links(5)}</ul></nav>" if chance(0.5) else ""
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body>{top}{inner}{foot}</body></html>"


def _truths(nodes: list[Node]) -> np.ndarray:
    """1 for the nodes of a generated page's main text and for those around it."""
    y = np.zeros(len(nodes))
    for k, node in enumerate(nodes):
        y[k] = node.label == "in" or node.label is None and node.parent is not None and y[node.parent.order] == 1
    for node in reversed(nodes):
        if y[node.order] and node.parent is not None and node.parent.label is None:
            y[node.parent.order] = 1
    return y


@functools.lru_cache(2)
def fitted(pages: int = TRAIN_PAGES, seed: int = SEED) -> Boosted:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        root = parse(_page(rng))
        nodes = _walk(root)
        xs.append(features(nodes))
        ys.append(_truths(nodes))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: list[str], model: Boosted) -> list[str]:
    roots = [parse(p) for p in pages]
    walked = [_walk(r) for r in roots]
    if not walked:
        return []
    odds = model.score(np.concatenate([features(n) for n in walked]))
    out, at = [], 0
    for root, nodes in zip(roots, walked, strict=True):
        out.append(_text(root, decode(nodes, odds[at : at + len(nodes)].copy())))
        at += len(nodes)
    return out


def extract_pages(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """Rows (page_id, url, text)."""
    model = fitted() if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 19):
                texts = extract([h or "" for h in part["html"].to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])
            release()

    kind = pages.schema["page_id"].dataType.simpleString()
    return in_batches(pages.select("page_id", "url", "html")).mapInArrow(run, f"page_id {kind}, url string, text string")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).selectExpr("page_id", "url", "text", "cast(length(text) as bigint) as n_chars")

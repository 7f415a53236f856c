"""The content tree of a main tier: groups, retraces, replacements and notes, walked by domain.

A stack parser turns a main tier into nested items, which come out as an array in document
order, each naming its parent and the kinds of all that enclose it.  Walks are expressions
over that array; only parsing and rebuilding run over texts, one row at a time within Arrow
batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from parlance.functions.slices import by_row
from parlance.operators.morphology import TAG_MARKS, TERMINATORS, token_places

NAK = "\x15"
#: Notes that make what stands before them a retrace, and the note that takes it out of morphology.
RETRACES = ("[/]", "[//]", "[///]", "[/-]", "[/?]")
EXCLUDED = "[e]"
#: Brackets of groups by the kind of group.
GROUPS = {"<": (">", "group"), "‹": ("›", "pho_group"), "〔": ("〕", "sin_group"), "“": ("”", "quotation")}
#: Words that stand for what was not understood.
UNTRANSCRIBED = ("xxx", "yyy", "www")
#: Categories of words that a domain leaves out; the other domains leave none out.
LEFT_OUT = {
    "mor": ("nonword", "fragment", "filler", "omission", "untranscribed", "timing", "empty"),
    "wor": ("nonword", "fragment", "omission", "untranscribed", "timing", "empty"),
}
DOMAINS = ("mor", "wor", "pho", "sin", "fa")

NODE = "struct<id:int,parent:int,kind:string,raw:string,clean:string,category:string,form:string,lang:string,notes:array<string>,within:array<string>,size:int>"

_CLOSERS = {close: kind for close, kind in GROUPS.values()}
_TOKEN = re.compile(rf"\+<(?=\s|$)|\[[^\]]*\]|{NAK}[^{NAK}]*{NAK}|[<>‹›〔〕“”]|[^\s\[\]<>‹›〔〕“”{NAK}]+|\S")
_FORM = re.compile(r"@(?!s(?::|$))([A-Za-z]+)(?::[A-Za-z]+)?(?=@|$)")
_LANG = re.compile(r"@s(?::([A-Za-z+&]+))?$")
_PAUSE = re.compile(r"\((?:\.{1,3}|[0-9:]*\.?[0-9]+)\)$")
_TIMING = re.compile(r"[0-9]+_[0-9]+$")
#: What is no letter of a word: lengthening, stress, syllable pauses, compounds, overlap and prosody marks, parentheses of what was left unsaid.
_MARKS = re.compile(r"(?<=\S):+|[\^+()ˈˌ⌈⌉⌊⌋↑↓°∆∇☺♋♉⁎⁇≋≈▔▁§‖]")
_PREFIXES = {"&-": "filler", "&+": "fragment", "&~": "nonword"}


@dataclass
class Item:
    """A node with what it encloses."""

    kind: str
    raw: str = ""
    clean: str = ""
    category: str | None = None
    form: str | None = None
    lang: str | None = None
    notes: list[str] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)


def word_item(raw: str) -> Item:
    """A word with its category, its special form and language, and its letters."""
    body, category = raw, None
    for prefix, name in _PREFIXES.items():
        if raw.startswith(prefix):
            body, category = raw[len(prefix) :], name
    lang = _LANG.search(body)
    body = body[: lang.start()] if lang else body
    form = _FORM.search(body)
    body = body[: form.start()] + body[form.end() :] if form else body
    if category is None and body.startswith("0") and len(body) > 1:
        body, category = body[1:], "omission"
    elif category is None and body.lower() in UNTRANSCRIBED:
        category = "untranscribed"
    elif category is None and _TIMING.match(body):
        category = "timing"
    clean = _MARKS.sub("", body)
    if not clean and category is None:
        category = "empty"
    return Item("word", raw, clean, category, form[1] if form else None, (lang[1] or "") if lang else None)


def _leaf(token: str) -> Item:
    if token in TAG_MARKS:
        return Item("separator", token, token)
    if token.startswith(NAK):
        return Item("bullet", token)
    if token in TERMINATORS:
        return Item("terminator", token)
    if _PAUSE.match(token):
        return Item("pause", token)
    if token.startswith("&=") or token.startswith("&*"):
        return Item("event", token)
    if token in "[]":
        return Item("marker", token)
    if token == "0":
        return Item("action", token)
    if re.match(r"\+[<^,+\"≈≋]", token) or re.match(r"&[{}]", token):
        return Item("marker", token)
    item = word_item(token)
    return Item("marker", token) if item.category == "empty" else item


def parse(text: str) -> list[Item]:
    """The items of a main tier.  A note with nothing before it, and a closing bracket with nothing open, are markers; what is never closed ends with the tier."""
    root = Item("tier")
    stack, closers = [root], [""]
    for token in _TOKEN.findall(text):
        into = stack[-1].items
        if token in GROUPS:
            group = Item(GROUPS[token][1], token)
            into.append(group)
            stack.append(group)
            closers.append(GROUPS[token][0])
        elif token in _CLOSERS:
            if token in closers:
                while closers.pop() != token:
                    stack.pop()
                stack.pop()
            else:
                into.append(Item("marker", token))
        elif not token.startswith("["):
            into.append(_leaf(token))
        elif token.startswith(("[^", "[+", "[-")):
            into.append(Item("freecode", token))
        elif not into or into[-1].kind in ("separator", "bullet", "terminator", "marker", "freecode"):
            into.append(Item("marker", token))
        elif token in RETRACES:
            into[-1] = Item("retrace", token, items=[into[-1]])
        elif token.startswith("[: ") or token.startswith("[:: "):
            last = into[-1]
            if last.kind == "word":
                last.kind, last.items = "replaced", [word_item(w) for w in token[:-1].split()[1:]]
                last.notes.append(token.split()[0])
            else:
                last.notes.append(token)
        else:
            into[-1].notes.append(token)
    return root.items


def render(items: Iterable[Item]) -> str:
    """The main tier of items."""

    def parts(item: Item) -> Iterator[str]:
        if item.kind == "retrace":
            yield from parts(item.items[0])
            yield item.raw
        elif item.kind == "replaced":
            yield item.raw
            yield f"{item.notes[0]} {' '.join(w.raw for w in item.items)}]"
        elif item.raw in GROUPS:
            yield item.raw + render(item.items) + GROUPS[item.raw][0]
        else:
            yield item.raw
        yield from item.notes[item.kind == "replaced" :]

    return " ".join(p for item in items for p in parts(item))


def flat(items: list[Item]) -> list[dict]:
    """Items in document order, with parents and what encloses them."""
    out: list[dict] = []

    def put(item: Item, parent: int | None, within: list[str]) -> None:
        own = len(out)
        out.append({"id": own, "parent": parent, "kind": item.kind, "raw": item.raw, "clean": item.clean, "category": item.category, "form": item.form, "lang": item.lang, "notes": item.notes, "within": within, "size": len(item.items)})
        inner = [*within, item.kind] + ["excluded"] * (EXCLUDED in item.notes)
        for x in item.items:
            put(x, own, inner)

    for item in items:
        put(item, None, [])
    return out


def tree(text: Column) -> Column:
    """A1: the content tree of a main tier as an array of nodes in document order; a null text has no tree.

    Kinds are ``word``, ``replaced`` (its replacement's words are below it), ``group``, ``pho_group``, ``sin_group``,
    ``quotation``, ``retrace`` (of the one item below it), ``separator``, ``pause``, ``event``, ``action``, ``freecode``,
    ``bullet``, ``terminator`` and ``marker``.
    """

    return by_row(lambda t: None if t is None else flat(parse(t)), f"array<{NODE}>", text)


def domain_nodes(nodes: Column, domain: str) -> Column:
    """B1: the nodes that a domain has tier items for, in order.

    ``mor`` skips retraces and what is marked as excluded, takes a replacement for the word it replaces, and counts
    separators with tags.  ``wor``, ``pho`` and ``sin`` keep what was spoken; ``pho`` and ``sin`` take every kind of word but
    leave groups of their own kind to the group.  ``fa`` (forced alignment) takes replacements, retraces and all groups.
    """
    inside = lambda x, kind: F.array_contains(x["within"], kind)
    kept = lambda x: ~F.coalesce(x["category"].isin(*LEFT_OUT[domain if domain in LEFT_OUT else "wor"]), F.lit(False))
    word = lambda x: x["kind"] == "word"
    replaced = lambda x: x["kind"] == "replaced"
    spoken = lambda x: (word(x) & ~inside(x, "replaced")) | (replaced(x) & ~F.coalesce(x["category"] == "omission", F.lit(False)))
    if domain == "mor":
        words = lambda x: (word(x) | (replaced(x) & (x["size"] == 0))) & kept(x) | ((x["kind"] == "separator") & x["raw"].isin(*TAG_MARKS))
        return F.filter(nodes, lambda x: words(x) & ~inside(x, "retrace") & ~inside(x, "excluded") & ~F.array_contains(x["notes"], EXCLUDED))
    if domain == "fa":
        return F.filter(nodes, lambda x: (word(x) | (replaced(x) & (x["size"] == 0))) & kept(x))
    if domain == "wor":
        return F.filter(nodes, lambda x: spoken(x) & kept(x))
    return F.filter(nodes, lambda x: spoken(x) & ~inside(x, f"{domain}_group"))


def domain_words(nodes: Column, domain: str) -> Column:
    """B1: the letters of a domain's words, as models take them."""
    return F.transform(domain_nodes(nodes, domain), lambda x: x["clean"])


# --- rebuilding (H28) -------------------------------------------------------------------------

REBUILT = "struct<text:string,tags:array<struct<node:int,tokens:array<int>>>>"
_PLAIN = re.compile(r"[^\s\[\]<>‹›〔〕“”@&+]+(?:[+'’_-][^\s\[\]<>‹›〔〕“”@&+]+)*$")


def _parsed(token: str) -> Item | None:
    """A token as an item of a main tier; None if it is none (white space inside, brackets, terminators)."""
    if token in TAG_MARKS:
        return Item("separator", token, token)
    return word_item(token) if token not in TERMINATORS and _PLAIN.match(token) and re.search(r"\w", token) else None


def rebuilt(text: str, nodes: list[int], places: list[list[int]], tokens: list[str]) -> tuple[str, list[dict]]:
    """The main tier with its words replaced by tokens inside whatever encloses them, and which tokens each node's tags come from.

    ``nodes`` are the places of the words in document order, ``places`` each word's tokens.  A plain word becomes its
    tokens; one that several words share is written where it comes first; one that is no word keeps the word.  A word
    that notes stand behind, a replaced one and each word of a replacement stay one item and take their first token, unless
    it is a separator or a terminator.  Separators keep their place and their tags; retraces are not touched.
    """
    want = dict(zip(nodes, places, strict=True))
    written: set[int] = set()
    tags: list[dict] = []
    number = 0

    def claim(node: int, own: list[int]) -> bool:
        """Whether a word's tokens are not all taken by words before it."""
        if own and all(t in written for t in own):
            tags.append({"node": node, "tokens": []})
            return False
        tags.append({"node": node, "tokens": [t for t in own if t not in written]})
        written.update(own)
        return True

    def in_place(item: Item, node: int) -> None:
        own = want[node]
        if claim(node, own) and own and tokens[own[0]] != item.clean and tokens[own[0]] not in TAG_MARKS:
            made = _parsed(tokens[own[0]])
            if made:
                item.raw, item.clean, item.category, item.form, item.lang = made.raw, made.clean, made.category, made.form, made.lang

    def walk(items: list[Item]) -> list[Item]:
        nonlocal number
        out: list[Item] = []
        for item in items:
            node, number = number, number + 1
            if item.kind == "word" and node in want and not item.notes:
                own = want[node]
                if not claim(node, own):
                    continue
                if not own or len(own) == 1 and tokens[own[0]] == item.clean:
                    out.append(item)
                    continue
                for t in own:
                    made = _parsed(tokens[t])
                    out.append(made or item)
                    if made is None:
                        break
            elif item.kind == "separator" and node in want:
                claim(node, want[node])
                out.append(item)
            else:
                if item.kind in ("word", "replaced") and node in want:
                    in_place(item, node)
                if item.kind == "replaced":
                    for x in item.items:
                        if number in want:
                            in_place(x, number)
                        number += 1
                else:
                    item.items = walk(item.items)
                out.append(item)
        return out

    return render(walk(parse(text))), tags


def retokenized(df: DataFrame, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """Adds ``rebuilt`` (text, tags): a main tier over a tokenizer's tokens; ``tags`` has each word's node and the tokens whose tags it takes."""

    def one(t: str | None, ids: list[int], places: list[list[int]], words: list[str]) -> dict:
        return dict(zip(("text", "tags"), (None, None) if t is None else rebuilt(t, ids, places, words), strict=True))

    # An outer explode of one element binds the tree, and then what is made of it: one function's result is another's argument.
    out = df.withColumn("_nodes", F.explode_outer(F.array(tree(F.col(text)))))
    out = out.withColumn("_nodes", domain_nodes(F.col("_nodes"), "mor"))
    words = F.coalesce(tokens, F.array().cast("array<string>"))
    places = token_places(F.transform("_nodes", lambda x: x["clean"]), words)
    out = out.withColumn("_nodes", F.explode_outer(F.array(F.struct(F.transform("_nodes", lambda x: x["id"]).alias("ids"), places.alias("places"), words.alias("words")))))
    return out.withColumn("rebuilt", by_row(one, REBUILT, F.col(text), F.col("_nodes.ids"), F.col("_nodes.places"), F.col("_nodes.words"))).drop("_nodes")

"""Personal data, also behind disguises, with offsets of the source text.

Base detectors read the text as it is.  Texts with a trace of disguise pass two transducers
as well: one over characters (homoglyphs, wide and foreign digits, invisible characters) and
one over tokens (spelled digits, ``plus``, ``at`` and ``dot``).  Each output character keeps the
source interval it came from, so that what the detectors find in the normalised text is
mapped back to source characters.  Such spans are added to the base ones, which all stay; one
that a base span of its kind covers wholly adds nothing, a longer one stands beside the base span.

Results for odd input: a null text counts as empty; an empty text has no spans and the
digest of the empty string.  Rows are read one by one, so repeated rows get equal results;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.llm._common import in_batches, release, slices, table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins at the first of a run of digits or not in the run at all, so no other place is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Characters that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".", "﹒": ".", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
# Characters without a width.
INVISIBLE = "­​‌‍⁠﻿"
# The names of the digits 0 to 9 in four languages.
DIGIT_NAMES = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
_VALUE = {name: str(k) for names in DIGIT_NAMES for k, name in enumerate(names)} | {"oh": "0"}


def _char_table() -> dict[int, str]:
    out = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): "" for c in INVISIBLE}
    out |= {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}
    for start in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        out |= {start + k: str(unicodedata.decimal(chr(start + k))) for k in range(10)}
    return out


_CHARS = _char_table()
_DISGUISED_CHAR = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_CHARS)) + "]")
_NAME = "(?:" + "|".join(sorted(map(re.escape, _VALUE), key=lambda x: (-len(x), x))) + ")"
_NAMES = frozenset(_VALUE)
_BREAKS = re.compile(r"[-,.]+")
_UNIT = rf"(?:{_NAME}(?![^\W_])|[0-9]+)"
_GAP = r"(?:[\x20\-,.]{1,2}(?:dot[\x20])?)"
#: Runs of digit names and written digits, and two of them of which one is a name: where there is none there is no run.
_NAMES_RUN = re.compile(rf"(?<![^\W_]){_UNIT}(?:{_GAP}{_UNIT})+", re.IGNORECASE)
_SOME_NAMES = re.compile(rf"(?<![^\W_])(?:{_NAME}{_GAP}{_UNIT}|[0-9]+{_GAP}{_NAME})(?![^\W_])", re.IGNORECASE)
_MARKED_AT = r"\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20@\x20|\x20at\x20"
_MARKED_DOT = r"\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20"
_AT = re.compile(rf"{_MARKED_AT}|@", re.IGNORECASE)
_DOT_BEFORE = re.compile(rf"(?:{_MARKED_DOT})\Z", re.IGNORECASE)
_DOT = re.compile(rf"{_MARKED_DOT}|\.", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
#: A disguised dot has no more characters than this.
_DOT_WIDTH = 9
_BRACKET = re.compile(r"[\[({<]\x20?(?:at|dot|@|\.)\x20?[\])}>]", re.IGNORECASE)
_SPACED_AT = re.compile(r"\x20(?:@|at)\x20[A-Za-z0-9-]+(?:\.|\x20dot\x20)[A-Za-z0-9]", re.IGNORECASE)
_DOT_BETWEEN_DIGITS = re.compile(r"(?<=[0-9])(?:\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20)(?=[0-9])", re.IGNORECASE)
_PLUS = re.compile(r"(?<![^\W_])plus[\x20-](?=[0-9(])", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c)
        if k & 1:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of a local part, ``@`` and a dotted domain: each starts at the first of the characters before its ``@``."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind, leftmost and without overlap."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if not _DIGIT.search(text):
        return found
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


class Mapped:
    """A text with, for each of its characters, the source interval it came from."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Intervals replaced; each character of a replacement comes from its whole interval."""
        if not edits:
            return self
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        parts.append(self.text[at:])
        return Mapped("".join(parts), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, span: tuple[int, int]) -> tuple[int, int]:
        return self.starts[span[0]], self.ends[span[1] - 1]


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn a run of digit names into digits, if it has at least four digits, written ones included.

    Names that stand side by side become one number; next to written digits the gap stays.
    """
    units = [(n.start(), n.end(), n.group().lower()) for n in re.finditer(r"[^\W\d_]+|[0-9]+", m.group())]
    digits = sum(len(n) if n.isdigit() else n in _VALUE for *_, n in units)
    if digits < 4 or not any(n in _VALUE for *_, n in units):
        return []
    edits, at, base = [], None, m.start()
    for a, b, n in units:
        if n.isdigit():
            at = None
        elif n in _VALUE:
            edits.append((base + (a if at is None else at), base + b, _VALUE[n]))
            at = b
        else:  # the word "dot"
            start = a
            while start and m.group()[start - 1] in " -,.":
                start -= 1
            edits.append((base + (start if at is None else at), base + b + 1, "."))
            at = b + 1
    return edits


def _mail_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that undo the disguises of mail addresses: each is sought around its ``@``, over no character twice."""
    edits, floor = [], 0
    for m in _AT.finditer(text):
        if m.start() < floor:
            continue
        dots, start, disguised = [], m.start(), False
        while True:
            end = start
            while start > floor and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start == end:
                start = dots.pop(0)[1] if dots else start  # nothing stands before this dot
                break
            d = _DOT_BEFORE.search(text[max(floor, start - _DOT_WIDTH) : start])
            if d is None:
                break
            low = start - len(d.group())
            if low <= floor or text[low - 1] not in _LOCAL_CHARS:
                break
            dots.insert(0, (low, start))
            start = low
        if start == m.start():
            continue
        label = _LABEL.match(text, m.end())
        at, after = (label.end() if label else -1), []
        while at >= 0:
            d = _DOT.match(text, at)
            label = _LABEL.match(text, d.end()) if d else None
            if label is None:
                break
            if d.group() != ".":
                after.append((d.start(), d.end()))
                disguised = True
            else:
                after.append(None)
            at = label.end()
        if not after:
            continue
        plain = m.group().lower() == " at "
        if plain and not disguised and not dots and not re.search(r"[0-9._+-]", text[start : m.start()]):
            continue  # "look at example.com" names no mailbox
        edits += [(a, b, ".") for a, b in dots]
        if m.group() != "@":
            edits.append((m.start(), m.end(), "@"))
        edits += [(x[0], x[1], ".") for x in after if x]
        floor = at
    return edits


def normalise(text: str) -> Mapped | None:
    """The text after both transducers; None if it shows no trace of disguise."""
    out: Mapped | None = None
    if not text.isascii() and _DISGUISED_CHAR.search(text):
        out = Mapped(text).rewritten([(m.start(), m.end(), _CHARS[ord(m.group())]) for m in _DISGUISED_CHAR.finditer(text)])
    now = out.text if out else text
    lower = now.lower()
    if not _NAMES.isdisjoint(_BREAKS.sub(" ", lower).split()) and _SOME_NAMES.search(now):
        edits = [e for m in _NAMES_RUN.finditer(now) for e in _spelled(m)]
        out = (out or Mapped(text)).rewritten(edits) if edits else out
        now = out.text if out else now
    if "plus" in lower and _PLUS.search(now):
        out = (out or Mapped(text)).rewritten([(m.start(), m.end(), "+") for m in _PLUS.finditer(now)])
        now = out.text
    if _BRACKET.search(now) or "dot" in lower and _DOT_BETWEEN_DIGITS.search(now):
        out = (out or Mapped(text)).rewritten([(m.start(), m.end(), ".") for m in _DOT_BETWEEN_DIGITS.finditer(now)])
        now = out.text
    if _BRACKET.search(now) or _SPACED_AT.search(now) or "@" in now and "\x20dot\x20" in lower:
        out = (out or Mapped(text)).rewritten(_mail_edits(now))
    return out


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and added spans of each kind."""
    base = detect(text)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mapped = normalise(text)
    if mapped is not None and mapped.text != text:
        for kind, spans in detect(mapped.text).items():
            had = base[kind]  # in order, without overlap
            starts = [x for x, _ in had]
            for span in spans:
                a, b = mapped.source(span)
                k = bisect_right(starts, a) - 1
                if k < 0 or had[k][1] < b:
                    added[kind].append((a, b))
    return base, added


def pii_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, base, added): spans as arrays of (kind, start, end) of the source text."""
    span = "array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [find(t or "") for t in part["text"].to_pylist()]
                both = [pa.array([[{"kind": k, "start": a, "end": b} for k in KINDS for a, b in f[j][k]] for f in found], kind) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *both], names=["doc_id", "base", "added"])
            release()

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {id_kind}, base {span}, added {span}")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    order = F.expr("array_sort(concat(base, added), (x, y) -> case when array_position(array('email', 'ip', 'card', 'phone'), x.kind) < array_position(array('email', 'ip', 'card', 'phone'), y.kind) then -1 when x.kind != y.kind then 1 when x.start < y.start then -1 when x.start > y.start then 1 when x.end < y.end then -1 when x.end > y.end then 1 else 0 end)")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(order).alias("spans"))


MASK = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def masked(text: str) -> str:
    """The text with every span replaced by its kind; of spans that overlap the first one names the kind."""
    base, added = find(text)
    spans = sorted((a, b, k) for x in (base, added) for k in KINDS for a, b in x[k])
    if not spans:
        return text
    parts, at = [], 0
    for a, b, k in spans:
        if a >= at:
            parts += [text[at:a], MASK[k]]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, with personal data masked and ``n_chars`` counted anew; a null text stays null.

    Only texts pass through Python; other columns stay as they are.
    """
    names = docs.columns

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else masked(t))
            release()

    out = in_batches(docs).withColumn("text", mask("text"))
    if "n_chars" in names:
        # The new text is bound by an outer explode of one element, so that it is made once for both columns.
        out = out.withColumn("text", F.explode_outer(F.array("text")))
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)

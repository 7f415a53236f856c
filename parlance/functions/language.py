"""Language of a text by its script and the ranks of its trigrams.

Profiles are the most frequent trigrams of each language in order, counted over texts whose
language is known.  A text is first told by the script that most of its letters have; scripts
of one language end there.  Otherwise its own trigrams are ranked, and the language whose
profile has them least out of place is taken.  The confidence is how far the second best is
behind, against what is to be expected of so many trigrams.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Trigrams of a profile, and of a text that are ranked.
TOP = 300
#: Trigrams that a task counts at once, and languages whose texts it holds back for that.
COUNTED, LANGUAGES = 1 << 18, 64
# Scripts by their letters, and the language of those that only one language in use has.
SCRIPTS = {
    "latin": "A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿ", "cyrillic": "Ѐ-ԯ", "arabic": "ؠ-ۿ", "devanagari": "ऀ-ॿ", "han": "㐀-䶿一-鿿", "kana": "ぁ-ヿ", "hangul": "ᄀ-ᇿ가-힯",
    "greek": "Ͱ-Ͽ", "hebrew": "א-ת", "thai": "ก-๛", "georgian": "Ⴀ-ჿ", "armenian": "Ա-և", "tamil": "஀-௿", "bengali": "ঀ-৿",
}
ONLY = {"kana": "jpn", "hangul": "kor", "han": "zho", "greek": "ell", "hebrew": "heb", "thai": "tha", "georgian": "kat", "armenian": "hye", "tamil": "tam", "bengali": "ben"}

#: The number of each letter's script, from 1; all of them lie in the table.
_SCRIPT = np.zeros(1 << 16, dtype=np.int8)
for _n, _letters in enumerate(SCRIPTS.values(), 1):
    for _run in re.findall("(?s).-.|.", _letters):
        _SCRIPT[ord(_run[0]) : ord(_run[-1]) + 1] = _n
_OTHER = re.compile(r"[\W\d_]+")


def plain_words(text: Column) -> Column:
    """A text's lower-cased words, with a space before and behind each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(text: Column) -> Column:
    """The trigrams of a text's lower-cased words, each with a space before and behind, as an array."""
    return F.regexp_extract_all(plain_words(text), F.lit("(?=(...))"), F.lit(1))  # a lookahead takes up nothing, so there is a match at each place


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _codes(text: str) -> np.ndarray:
    """A number of 63 bits for the trigram at each place; numbers are in the order of the trigrams."""
    at = _points(text)
    return (at[:-2] << 42) | (at[1:-1] << 21) | at[2:]


def _gram(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, gram, n) of rows (lang, text), counted over about ``COUNTED`` trigrams of one language at a time."""
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def counts(lang: str) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        del size[lang]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(map(_gram, codes.tolist()), pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            name, codes = lang.as_py(), _codes(text.as_py())
            held.setdefault(name, []).append(codes)
            size[name] = size.get(name, 0) + len(codes)
            if size[name] > COUNTED or len(held) > LANGUAGES:
                yield counts(name)
    for name in list(held):
        yield counts(name)


def profiles(texts: DataFrame, top: int = TOP) -> DataFrame:
    """Rows (lang, gram, rank): the ``top`` trigrams of each language of rows (text, lang), ties by the trigram; a table of ``top`` rows a language."""
    plain = texts.where("lang is not null and text is not null").select("lang", plain_words(F.col("text")).alias("text"))
    count = plain.mapInArrow(_counted, "lang string, gram string, n long").where("trim(gram) != ''").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return count.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top).select("lang", "gram", "rank")


def script_of(text: str) -> str | None:
    """The script of most letters; of ties the first of the table.  Kana make a text Japanese whatever Han letters it has."""
    at = _points(text)
    count = dict(zip(SCRIPTS, np.bincount(_SCRIPT[at[at < len(_SCRIPT)]], minlength=len(SCRIPTS) + 1)[1:].tolist(), strict=True))
    if count["kana"] and count["kana"] + count["han"] > sum(count.values()) / 2:
        return "kana"
    best = max(count, key=count.get)
    return best if count[best] else None


def told(text: str, ranks: dict[str, dict[str, int]], top: int = TOP) -> tuple[str | None, float]:
    """A text's language and the confidence in it, from the ranks of each language's trigrams."""
    script = script_of(text)
    if script is None:
        return None, 0.0
    if script in ONLY:
        return ONLY[script], 1.0
    plain = f" {_OTHER.sub(' ', text.lower()).strip()} "
    codes, count = np.unique(_codes(plain), return_counts=True)
    own = [_gram(c) for c in codes[np.argsort(-count, kind="stable")[:top]].tolist()]
    if not own or not ranks:
        return None, 0.0
    away = {lang: sum(min(top, abs(k - known[g])) if g in known else top for k, g in enumerate(own, 1)) for lang, known in ranks.items()}
    close = sorted((-(top * len(own) - d), lang) for lang, d in away.items())
    best, second = -close[0][0], -close[1][0] if len(close) > 1 else 0
    if best == 0:
        return None, 0.0
    lead = (best - second) / max(second, 1)
    return close[0][1], min(1.0, lead / (12 / len(count) + 0.05))


def detector(profile: DataFrame, top: int = TOP) -> Callable[[Column], Column]:
    """A function for ``words.detected_language``: a text's (lang, confidence) by the profiles, which every task gets (``top`` rows a language)."""
    ranks: dict[str, dict[str, int]] = {}
    for r in profile.collect():
        ranks.setdefault(r.lang, {})[r.gram] = r["rank"]

    @F.pandas_udf("struct<lang:string,confidence:double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else told(t, ranks, top) for t in texts], columns=["lang", "confidence"])

    return run

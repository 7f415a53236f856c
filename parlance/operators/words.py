"""Operators on words of utterances: runs, merging, splitting, repetition, normal forms."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from parlance.operators.timing import overlap_join

# Fixed values.
PUNCTUATION = (".", "?", "!", ",", "‡", "„", "+/.", "+//.", "+//?", "+...", "++.", '+".', '+"?')
FILLERS = ("um", "uhm", "em", "mhm", "uhhm", "eh", "uh", "hm")
FILLED_PAUSES = {"um": "&-um", "ur": "&-ur", "uh": "&-uh"}
SPELLINGS = {"mm-hmm": "mhm", "mm-hum": "mhm", "'em": "(th)em", "cuz": "(be)cause", "'cause": "(be)cause"}
STARTERS = (
    "and", "but", "did", "do", "does", "go", "have", "has", "had", "he", "how", "i", "is", "it", "no", "now", "okay", "so", "then", "they", "we", "well",
    "what", "when", "where", "who", "why", "yes", "you",
)
LONG_PAUSE_MS = 800
#: Ideographs, as a Java character class.
CJK = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2CEAF}\\x{2F800}-\\x{2FA1F}]"
#: Words of a chunk that separate its parts, and right-to-left marks that end an utterance.
SEPARATORS, RTL_MARKS = ("‡", "„", ","), ("؟", "۔", "،", "؛")
ENDINGS = (".", "?", "!", "+...", "+/.", "+//.", "+/?", "+!?", '+"/.', '+".', "+//?", "+..?", "+.", "...", "(.)")
LONG_TURN = 300


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is bound as the element of an array, so that it is made once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def exploded(df: DataFrame, text: str = "text") -> DataFrame:
    """B1: a row for each word, with its zero-based ordinal ``p``."""
    trimmed = F.trim(F.col(text))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(words).alias("p", "word"))


def comparable(df: DataFrame) -> DataFrame:
    """B2: words that are neither punctuation nor fillers."""
    w = F.trim("word")
    return df.where(~w.isin(*PUNCTUATION) & ~F.lower(w).isin(*FILLERS))


def speaker_runs(df: DataFrame) -> DataFrame:
    """Adds ``mono``, the number of the run of rows with one speaker."""
    w = Window.partitionBy("f").orderBy("i")
    change = F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(1))
    return df.withColumn("_c", change).withColumn("mono", (F.sum("_c").over(w) - 1).cast("long")).drop("_c")


def merged_compounds(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Neighbouring words of known pairs (first, second) are joined, greedily from the left.

    A greedy scan merges at the odd positions of each maximal run of matches.
    """
    w = Window.partitionBy("f", "u").orderBy("p")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    known = pairs.select(F.col("first").alias("word"), F.col("second").alias("nxt")).distinct().withColumn("m", F.lit(True))
    df = df.withColumn("nxt", F.lead("word").over(w)).join(known, ["word", "nxt"], "left").withColumn("m", F.coalesce("m", F.lit(False)))
    # Runs are told by rows numbered over the turn, so its words are sorted no more than once.
    df = df.withColumn("k", F.row_number().over(w))
    df = df.withColumn("last", F.coalesce(F.max(F.when(~F.col("m"), F.col("k"))).over(so_far), F.lit(0)))
    df = df.withColumn("merge", F.col("m") & ((F.col("k") - F.col("last")) % 2 == 1))
    df = df.withColumn("gone", F.coalesce(F.lag("merge").over(w), F.lit(False)))
    return df.where("not gone").select("f", "u", "p", F.when(F.col("merge"), F.concat("word", "nxt")).otherwise(F.col("word")).alias("word"))


def long_turns(df: DataFrame, most: int = LONG_TURN) -> DataFrame:
    """Adds ``chunk``, the number of the run of ``most`` words."""
    n = F.row_number().over(Window.partitionBy("f", "u").orderBy("p"))
    return df.withColumn("chunk", F.floor((n - 1) / most).cast("long"))


def into_utterances(df: DataFrame) -> DataFrame:
    """Words of each file end an utterance at an ending mark; rows (f, utt, tok, word).

    A word may be an ending mark (``ENDINGS``, or a right-to-left one, which becomes ASCII) or have one
    as its last character, which is split off.  An unterminated rest loses its trailing separators and
    gets a period; nothing is left of a rest of separators.
    """
    word = F.translate(F.replace(F.col("word"), F.lit("。"), F.lit(".")), "¿¡", "  ")
    whole = F.col("word").isin(*ENDINGS, *RTL_MARKS)
    last = F.substring("word", -1, 1)
    split = ~whole & last.isin(".", "?", "!", *RTL_MARKS)
    end = lambda c: F.struct(rtl_ascii(c).alias("word"), F.lit(True).alias("is_end"))
    body = F.struct(F.expr("substring(word, 1, length(word) - 1)").alias("word"), F.lit(False).alias("is_end"))
    plain = F.struct(F.col("word"), F.lit(False).alias("is_end"))
    parts = F.when(whole, F.array(end(F.col("word")))).when(split, F.array(body, end(last))).otherwise(F.array(plain))
    y = df.select("f", "p", word.alias("word")).select("f", "p", F.posexplode(parts).alias("j", "t")).select("f", "p", "j", "t.*")
    in_file = Window.partitionBy("f").orderBy("p", "j")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # Only the last utterance may be open, so rows numbered over the file tell all, and a file's words are sorted once.
    y = y.withColumns({"n": F.row_number().over(in_file).cast("long"), "utt": F.coalesce(F.sum(F.col("is_end").cast("int")).over(before), F.lit(0)).cast("long")})
    ends = F.when(F.col("is_end"), F.col("n"))
    y = y.withColumn("tok", F.col("n") - 1 - F.coalesce(F.max(ends).over(before), F.lit(0)))
    whole_file = Window.partitionBy("f")
    y = y.withColumns({"end": F.coalesce(F.max(ends).over(whole_file), F.lit(0)), "kept": F.max(F.when(~F.col("word").isin(*SEPARATORS), F.col("n"))).over(whole_file)})
    y = y.where((F.col("n") <= F.col("end")) | F.coalesce(F.col("n") <= F.col("kept"), F.lit(False)))
    own, period = F.struct("tok", "word"), F.struct((F.col("tok") + 1).alias("tok"), F.lit(".").alias("word"))
    opened = (F.col("n") > F.col("end")) & (F.col("n") == F.col("kept"))
    return y.select("f", "utt", F.explode(F.when(opened, F.array(own, period)).otherwise(F.array(own))).alias("t")).select("f", "utt", "t.tok", "t.word")


def _ranks(codes: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Names of the runs of 1, 2, 4, ... words that begin at each place: equal names for equal runs; a run stays in its utterance."""
    out, size, place = [codes], 1, np.arange(len(codes))
    longest = int((end - place).max(initial=0))
    while 4 * size <= longest:
        there = np.flatnonzero(place + 2 * size <= end)
        rank = np.full(len(codes), -1)
        rank[there] = np.unique(out[-1][there] * (len(codes) + 1) + out[-1][there + size], return_inverse=True)[1]
        out.append(rank)
        size *= 2
    return out


def repeats(codes: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For the words of utterances of the given sizes, one after another, whether each stands in the first of two equal neighbouring runs.

    For a run of n words every n-th place is compared with the place n further on: how far the two agree onwards and
    backwards, taken from names of runs of doubling length, tells all repeats of that length around them.  That makes
    n/1 + n/2 + ... places for an utterance of n words.
    """
    stop = np.cumsum(sizes)
    start = stop - sizes
    end, begin = np.repeat(stop, sizes), np.repeat(start, sizes)
    ranks = _ranks(codes, end)
    edges = np.zeros(len(codes) + 1, dtype=np.int64)
    firsts, gaps, held = [], [], 0
    order = np.argsort(-sizes, kind="stable")
    for n in range(1, int(sizes.max(initial=0)) // 2 + 1):
        own = order[: np.searchsorted(-sizes[order], -2 * n, side="right")]
        own = own[least[own] <= n]
        count = (sizes[own] - 1) // n
        at = np.repeat(start[own], count) + n * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
        firsts.append(at)
        gaps.append(n)
        held += len(at)
        if held < 1 << 18 and n < int(sizes.max()) // 2:
            continue
        i, gap = np.concatenate(firsts), np.repeat(gaps, [len(x) for x in firsts])
        firsts, gaps, held = [], [], 0
        j, on, back = i + gap, np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            for _ in range(2 if k == len(ranks) - 1 else 1):  # the longest runs are half as long as the longest agreement
                ok = j + on + (1 << k) <= end[i]
                a = np.where(ok, i + on, 0)
                ok &= ranks[k][a] == ranks[k][np.where(ok, j + on, 0)]
                on += ok * (1 << k)
                ok = i - back - (1 << k) >= begin[i]
                a = np.where(ok, i - back - (1 << k), 0)
                ok &= ranks[k][a] == ranks[k][np.where(ok, j - back - (1 << k), 0)]
                back += ok * (1 << k)
        hit = on + back >= gap
        np.add.at(edges, (i - back)[hit], 1)
        np.add.at(edges, (i + on)[hit], -1)
    return np.cumsum(edges[:-1]) > 0


def _marks(words: pd.Series, least: np.ndarray, skipped: frozenset[str] = frozenset()) -> pd.Series:
    sizes = np.array([0 if w is None else len(w) for w in words], dtype=np.int64)
    every = np.concatenate([np.zeros(0, dtype=object), *(np.asarray(w, dtype=object) for w in words if w is not None)])
    codes, names = pd.factorize(every)
    codes = np.where(codes < 0, len(names) + np.arange(len(codes)), codes)  # a null word is like no other
    codes = np.unique(codes, return_inverse=True)[1] if len(codes) else codes.astype(np.int64)
    kept = ~pd.Series(every, dtype=object).isin(skipped).to_numpy() if skipped else np.ones(len(every), dtype=bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(len(every), dtype=bool)
    out[kept] = repeats(codes[kept].astype(np.int64), np.bincount(owner[kept], minlength=len(sizes)).astype(np.int64), least)
    cuts = np.append(0, np.cumsum(sizes))
    return pd.Series([None if w is None else out[cuts[k] : cuts[k + 1]] for k, w in enumerate(words)], dtype=object)


def retraced(words: Column, least: int = 1) -> Column:
    """For each word whether it stands in the first of two equal neighbouring runs of at least ``least`` words."""

    @F.pandas_udf("array<boolean>")
    def run(ws: pd.Series) -> pd.Series:
        return _marks(ws, np.full(len(ws), least))

    return run(words)


def retraced_words(words: Column, lang: Column | None = None) -> Column:
    """E13 over an utterance's words: as ``retraced``, but marks and separators are passed over, and Chinese repeats have two words."""

    @F.pandas_udf("array<boolean>")
    def run(ws: pd.Series, langs: pd.Series) -> pd.Series:
        return _marks(ws, np.where(langs.isin(("yue", "zho")), 2, 1), frozenset((*ENDINGS, *SEPARATORS)))

    return run(words, F.lit("") if lang is None else lang)


def combined_letters(df: DataFrame) -> DataFrame:
    """Runs of one-letter words become one word."""
    w = Window.partitionBy("f", "u").orderBy("p")
    one = (F.octet_length("word") == 1) & F.rlike("word", F.lit("[A-Za-z]"))
    df = df.withColumn("one", one)
    fresh = ~(F.col("one") & F.coalesce(F.lag("one").over(w), F.lit(False)))
    df = df.withColumn("fresh", fresh.cast("int")).withColumn("g", F.sum("fresh").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]), "")
    return df.groupBy("f", "u", "g").agg(F.min("p").alias("p"), joined.alias("word")).drop("g")


def by_assignment(df: DataFrame) -> DataFrame:
    """Adds ``part``, the number of the run of words with one assignment ``g``."""
    w = Window.partitionBy("f", "u").orderBy("p")
    change = F.coalesce((F.col("g") != F.lag("g").over(w)).cast("int"), F.lit(0))
    return df.withColumn("_c", change).withColumn("part", F.sum("_c").over(w).cast("long")).drop("_c")


#: Separators inside recognised words, and what they become; marks without an entry go.
_SPLIT_MARKS, _SPLIT_ASCII = ".?？؟!！,，、،。", ".???!!,,,,."


def proportional_split(df: DataFrame, lang: str = "eng") -> DataFrame:
    """H8: rows (f, i, j, piece, a, b): recognised words cut at white space and separators, with the time shared by characters.

    A separator is a piece of its own without times, and inverted marks go.  A word that stays whole
    keeps its times; pieces of one whose end is not after its start have none.  A word that begins
    with a hyphen is joined to the piece before, which ends where it ends.  Cantonese pieces of
    ideographs are cut into characters.
    """
    pieces = F.regexp_extract_all(F.translate("word", "¿¡", "  "), F.lit(rf"([{_SPLIT_MARKS}]|[^\s\u3000{_SPLIT_MARKS}]+)"), 1)
    pieces = F.transform(pieces, lambda x: F.struct(F.translate(x, _SPLIT_MARKS, _SPLIT_ASCII).alias("piece"), F.rlike(x, F.lit(f"^[{_SPLIT_MARKS}]")).alias("mark")))
    if lang == "yue":
        cut = lambda x: ~x["mark"] & is_cjk(x["piece"]) & ~F.rlike(x["piece"], F.lit("[A-Za-z0-9]"))
        one = lambda c: F.struct(c.alias("piece"), F.lit(False).alias("mark"))
        pieces = F.flatten(F.transform(pieces, lambda x: F.when(cut(x), F.transform(cantonese_characters(x["piece"]), one)).otherwise(F.array(x))))
    rows = df.select("f", "i", "word", "a", "b").withColumn("pieces", pieces)
    in_file = Window.partitionBy("f").orderBy("i")
    before = F.coalesce(F.sum(F.size("pieces")).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joins = F.startswith("word", F.lit("-")) & (before > 0)
    rows = rows.withColumn("joins", joins)
    as_is = F.array(F.struct(F.col("word").alias("piece"), F.lit(False).alias("mark")))
    rows = rows.withColumn("pieces", F.when(F.col("joins"), as_is).otherwise(F.col("pieces")))
    whole = (F.size("pieces") == 1) & (F.get("pieces", 0)["piece"] == F.col("word")) & ~F.get("pieces", 0)["mark"]
    total = F.aggregate("pieces", F.lit(0), lambda acc, x: acc + F.when(x["mark"], 0).otherwise(F.length(x["piece"])))
    rows = rows.withColumns({"whole": whole, "total": total}).select("f", "i", "a", "b", "joins", "whole", "total", F.posexplode("pieces").alias("j", "x")).select("*", "x.*").drop("x")
    in_word = Window.partitionBy("f", "i").orderBy("j")
    length = F.when(F.col("mark"), 0).otherwise(F.length("piece"))
    rows = rows.withColumn("hi", F.sum(length).over(in_word)).withColumn("lo", F.col("hi") - length)
    span = (F.col("b") > F.col("a")) & (F.col("total") > 0) & ~F.col("mark")
    at = lambda c: F.when(span, F.col("a") + F.expr(f"((b - a) * {c}) div total"))
    rows = rows.withColumns({"s": F.when(F.col("whole"), F.col("a")).otherwise(at("lo")), "e": F.when(F.col("whole"), F.col("b")).otherwise(at("hi"))})
    # Words that join are tied to the last piece before them.
    rows = rows.withColumn("own", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(Window.partitionBy("f").orderBy("i", "j")))
    joined = F.array_sort(F.collect_list(F.struct("i", "j", "piece", F.when(F.col("joins"), F.col("b")).otherwise(F.col("e")).alias("e"))))
    out = rows.groupBy("f", "own").agg(F.min_by(F.struct("i", "j", F.col("s").alias("a")), F.struct("i", "j")).alias("h"), joined.alias("t"))
    return out.select("f", "h.i", "h.j", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("piece"), "h.a", F.element_at("t", -1)["e"].alias("b"))


def word_spans(words: DataFrame, tokens: DataFrame, bucket: int = 256) -> DataFrame:
    """Rows (f, p, t): tokens that share characters with a word, for two splittings of the same string.

    Both are joined as intervals of characters, by the buckets of them that they touch.
    """

    def offsets(df: DataFrame, n: str) -> DataFrame:
        w = Window.partitionBy("f").orderBy(n)
        hi = F.sum(F.length("piece")).over(w)
        return df.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.length("piece")).where("hi > lo")

    a = offsets(words, "p").select("f", F.col("p").alias("win"), F.col("lo").alias("ws"), F.col("hi").alias("we"))
    b = offsets(tokens, "t").select("f", F.col("t").alias("tok"), F.col("lo").alias("start"), F.col("hi").alias("end"))
    return overlap_join(b, a, bucket).select("f", F.col("win").alias("p"), F.col("tok").alias("t"))


# --- normal forms of one string ------------------------------------------------------


def normal_separators(text: Column) -> Column:
    """H9: full-width and other marks become ASCII ones; inverted marks go."""
    return F.translate(text, "？؟！，、،。¿¡", "??!,,,.")


def is_cjk(text: Column) -> Column:
    """Whether the text has a CJK ideograph."""
    return F.rlike(text, F.lit(CJK))


def rtl_ascii(text: Column) -> Column:
    """Right-to-left marks as ASCII ones."""
    return F.translate(text, "؟۔،؛", "?.,;")


# Corrections of Cantonese text; where several fit, the first from the left, and of those the longest, is made.
CANTONESE = {
    "聯繫": "聯繫", "聯係": "聯繫", "系啊": "係啊", "真系": "真係", "唔系": "唔係", "中意": "鍾意", "遊水": "游水", "羣組": "群組", "古仔": "故仔", "較剪": "鉸剪", "衝涼": "沖涼", "分鍾": "分鐘", "重復": "重複",
    "系": "係", "繫": "係", "呀": "啊", "噶": "㗎", "咧": "呢", "嗬": "喎", "只": "隻", "咯": "囉", "嚇": "吓", "啫": "咋", "哇": "嘩", "着": "著", "嘞": "喇", "啵": "噃", "甕": "㧬", "牀": "床", "松": "鬆", "吵": "嘈",
}
_CANTONESE_SPACE = "[\\s\u3000、。，！？「」：；]"


def cantonese_normal(text: Column, converted: Callable[[Column], Column] = lambda c: c) -> Column:
    """H5: Cantonese text with ``CANTONESE`` corrected.

    ``converted`` turns simplified into Hong Kong characters; its table is large and the caller's to bring.
    The text is cut into entries and what stands between, longest entries first, and each entry replaced; characters
    outside the range of those that entries begin with stay together.
    """
    keys = sorted(CANTONESE, key=lambda k: (-len(k), k))
    # A range is told by two comparisons, a set by one for each character.
    low, high = min(keys)[0], max(keys)[0]
    parts = F.regexp_extract_all(converted(text), F.lit(f"(?s)([^{low}-{high}]+|" + "|".join(keys) + "|.)"), 1)
    table = F.create_map(*[F.lit(x) for kv in CANTONESE.items() for x in kv])
    return F.array_join(F.transform(parts, lambda x: F.coalesce(table[x], x)), "")


def cantonese_characters(text: Column, converted: Callable[[Column], Column] = lambda c: c) -> Column:
    """H6: the characters of corrected Cantonese text but for CJK punctuation and white space."""
    return F.array_remove(F.split(F.regexp_replace(cantonese_normal(text, converted), f"{_CANTONESE_SPACE}+", ""), ""), "")


def mor_safe(text: Column) -> Column:
    """Reserved characters become underscores, white space goes."""
    return F.regexp_replace(F.regexp_replace(text, r"[|#\-&$~]", "_"), r"\s+", "")


def features_map(feats: Column) -> Column:
    """Features ``A=x|B=y`` as a map; of a repeated name the last value counts, and of ``A=x=y`` what stands between."""
    some = F.filter(F.split(feats, r"\|"), lambda x: F.contains(x, F.lit("=")))
    entries = F.transform(some, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.get(F.split(x, "="), 1).alias("value")))
    last = lambda es: F.filter(es, lambda e, k: ~F.exists(F.slice(es, k + 2, F.size(es)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(let(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), last))


def gra_relation(deprel: Column) -> Column:
    """A dependency relation in capitals with hyphens; null where it is no name."""
    up = F.replace(F.upper(deprel), F.lit(":"), F.lit("-"))
    return F.when(F.rlike(up, F.lit("^[A-Z][A-Z0-9-]*$")), up)


def chain_marks(refs: Column) -> Column:
    """Coreference marks of each word: ``(0`` opens, ``0)`` closes, ``(0)`` both, ``-`` none."""

    def one(r: Column) -> Column:
        return F.concat(F.when(r["is_start"], "(").otherwise(""), r["chain_id"].cast("string"), F.when(r["is_end"], ")").otherwise(""))

    return F.array_join(F.transform(refs, lambda w: F.when(F.size(w) == 0, F.lit("-")).otherwise(F.array_join(F.transform(w, one), " "))), ", ")


def status_marks(status: Column, word: Column) -> Column:
    """A compared word: ``+word`` if only the main text has it, ``-word`` if only the gold text has."""
    return F.concat(F.when(status == "extra_main", "+").when(status == "extra_gold", "-").otherwise(""), word)


def cache_key(*fields: Column) -> Column:
    """A digest of delimited fields."""
    return F.sha2(F.concat_ws("|", *fields), 256)


def speaker_index(label: Column) -> Column:
    """The number of a speaker label such as ``2`` or ``SPEAKER_02``; null without one."""
    return F.element_at(F.split(label, "_"), -1).try_cast("int")


def is_detectable(text: Column, least: int = 40) -> Column:
    """Whether a text has enough letters for its language to be told."""
    return F.regexp_count(F.trim(text), F.lit(r"\p{L}")) >= least


def detected_language(text: Column, detect: Callable[[Column], Column], confidence: float = 0.5) -> Column:
    """The language of a text, null where it is too short or ``detect`` (a struct of lang and confidence) is not sure."""
    return let(detect(F.trim(text)), lambda d: F.when(is_detectable(text) & (d["confidence"] >= confidence), d["lang"]))


def provider_text(text: Column) -> Column:
    """A recognised segment's text without markers ``<|…|>`` and corner brackets, its stops as single spaces."""
    out = F.regexp_replace(text, r"(?s)<\|.*?\|>", "")
    out = F.regexp_replace(out, r"(?s)<\|.*\z", "<|")
    return F.trim(F.regexp_replace(F.translate(out, "。，！？「」", "    "), r"\s+", " "))


def wer_normal(word: Column) -> Column:
    """Lower case without parentheses and hyphens."""
    return F.regexp_replace(F.lower(word), r"[()\-]", "")


def disfluency(word: Column) -> Column:
    """H7: English filled pauses, then informal spellings, as transcripts write them."""
    out = word
    for table in (SPELLINGS, FILLED_PAUSES):
        for k, v in table.items():
            out = F.when(F.lower(word) == k, F.lit(v)).otherwise(out)
    return out


def translation_input(text: Column, lang: Column) -> Column:
    """H12, before a translation model: Chinese texts lose spaces and get ideographic stops."""
    return F.when(lang.isin("yue", "zho"), F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("."), F.lit("。"))).otherwise(text)


def translation_output(text: Column, marks: tuple[str, ...] = ("‡", "„", ",", ".", "?", "!")) -> Column:
    """H12, after it: stops and quotes become ASCII, and each mark in turn gets a space before it."""
    out = F.translate(text, "。‘’\t\u200b", ".'' ")
    for m in marks:
        out = F.replace(out, F.lit(m), F.lit(f" {m}"))
    return out


def long_pauses(df: DataFrame) -> DataFrame:
    """Adds ``part``: a chunk's words (f, chunk, i, word, a, b) split where a starter word follows a long pause.

    A split needs two words before it since the last one, so of neighbouring places that could split every other one does, from the first on.
    """
    w = Window.partitionBy("f", "chunk").orderBy("i")
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    end = F.last(F.when(F.col("a").isNotNull(), F.col("b")), ignorenulls=True).over(before)
    bare = F.lower(F.regexp_replace("word", r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    rows = df.select("f", "chunk", "i", "word", "a", "b").withColumns({"_k": F.row_number().over(w), "_end": end})
    could = (F.col("_k") > 2) & (F.col("a") - F.col("_end") >= LONG_PAUSE_MS) & bare.isin(*STARTERS)
    rows = rows.withColumn("_could", F.coalesce(could, F.lit(False)))
    rows = rows.withColumn("_last", F.max(F.when(~F.col("_could"), F.col("_k"))).over(so_far))
    split = F.when(F.col("_could") & ((F.col("_k") - F.col("_last")) % 2 == 1), 1).otherwise(0)
    return rows.withColumn("part", F.sum(split).over(so_far).cast("int")).select("f", "chunk", "i", "word", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "part")


def failure_category(error: Column, message: Column) -> Column:
    """The category of a failure from the kind of its error and its message."""
    return (
        F.when(error.isin("ready_timeout", "health_check_failed"), "worker_timeout").when(error.isin("process_exited", "worker_io"), "worker_crash")
        .when(error == "protocol", F.when(F.contains(message, F.lit("timeout")), "worker_timeout").otherwise("worker_protocol")).when(error == "worker_response", "provider_transient")
        .when(error == "validation", "validation").when(error == "memory_pressure", "memory_pressure").otherwise("system")
    )


def retryable(category: Column) -> Column:
    """Whether a failure of this category may be tried again."""
    return category.isin("worker_crash", "worker_timeout", "provider_transient")

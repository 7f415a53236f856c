"""Sequential algorithms over one file's or one utterance's items, as Arrow functions.

Each takes whole lists in a row, so a row is the unit of work and nothing is gathered.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from parlance.functions.slices import by_row
from parlance.operators.align import align, edit_metrics
from parlance.operators.words import FILLERS, PUNCTUATION, let

# Spoken forms and what they are compared as; earlier groups win.
CLITICS = (("'s", "is"), ("'ve", "have"), ("'d", "had"), ("'m", "am"))
HESITATIONS = frozenset("um uhm em mhm uhhm eh uh hm".split())
EXPANSIONS = {
    "ok": "okay", "gimme": "give me", "hafta": "have to", "havta": "have to", "dunno": "don't know", "wanna": "want to", "gonna": "going to", "gotta": "got to", "kinda": "kind of",
    "sorta": "sort of", "shoulda": "should have", "sposta": "supposed to", "hadta": "had to", "alright": "all right", "alrightie": "all right", "this'll": "this will",
    "farmhouse": "farm house", "mm": "hm", "hmm": "hm", "til": "until", "ed": "education",
    "mba": "m b a", "tli": "t l i", "bbc": "b b c", "ai": "a i", "aa": "a a", "ii": "i i",
}


def conform(word: str, compounds: dict[str, tuple[str, str]] | None = None, letters: frozenset = frozenset(), names: frozenset = frozenset()) -> list[str]:
    """H1: the words that a word is compared as; tables of compounds, abbreviations and names are the caller's."""
    bare = word.strip()
    low = bare.lower()
    if compounds and low in compounds:
        return list(compounds[low])
    if bare in letters:
        return list(bare)
    for mark, spoken in CLITICS:
        if mark in low:
            return [low.partition("'")[0], spoken]
    if low in HESITATIONS:
        return ["um"]
    if "-" in low:
        return [x.strip() for x in low.split("-")]
    if low in names and low not in ("ok", "gimme", "hafta", "havta"):
        return ["name"]
    if low in EXPANSIONS:
        return EXPANSIONS[low].split(" ")
    return low.split("_")


def conformed(words: Column, compounds: dict[str, tuple[str, str]] | None = None, letters: frozenset = frozenset(), names: frozenset = frozenset()) -> Column:
    """H1 as an expression over arrays of words: the rules of ``conform`` in their order."""
    listed = lambda xs: F.array(*map(F.lit, xs))
    spoken = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), listed(v.split(" ")))])

    def one(word: Column) -> Column:
        def rules(x: Column) -> Column:
            bare, low = x["bare"], x["low"]
            out = F.when(F.lit(False), F.array().cast("array<string>"))
            if compounds:
                table = F.create_map(*[x for k, v in sorted(compounds.items()) for x in (F.lit(k), listed(v))])
                out = out.when(low.isin(*compounds), table[low])
            if letters:
                out = out.when(bare.isin(*letters), F.filter(F.split(bare, ""), lambda c: c != ""))
            for mark, verb in CLITICS:
                out = out.when(F.contains(low, F.lit(mark)), F.array(F.substring_index(low, "'", 1), F.lit(verb)))
            out = out.when(low.isin(*HESITATIONS), listed(["um"])).when(F.contains(low, F.lit("-")), F.transform(F.split(low, "-"), F.trim))
            if names:
                out = out.when(low.isin(*names) & ~low.isin("ok", "gimme", "hafta", "havta"), listed(["name"]))
            return F.coalesce(out.when(low.isin(*EXPANSIONS), spoken[low]), F.split(low, "_"))

        return let(F.struct(F.trim(word).alias("bare"), F.lower(F.trim(word)).alias("low")), rules)

    return F.flatten(F.transform(words, one))


def word_errors(hypothesis: list[str], reference: list[str], chinese: bool = False) -> dict:
    """D3: substitutions, insertions and deletions after normal forms, the words matched, and the lines of a diff.

    The rate is over the reference's own length.
    """
    if not reference:
        return {"wer": 0.0, "errors": 0, "total": 0, "matches": 0, "diff": ""}
    hyp, ref = ([w.replace("-", "") for w in x] for x in (hypothesis, reference))
    if chinese:
        hyp, ref = ([c for w in x for c in w] for x in (hyp, ref))
    else:
        hyp = [y for single, g in groupby(hyp, lambda w: len(w) == 1 and w.isascii() and w.isalpha()) for y in (["".join(g)] if single else g)]
    hyp, ref = ([y.lower().replace("(", "").replace(")", "") for w in x for y in conform(w)] for x in (hyp, ref))
    errors, before, expect = 0, None, False
    kept: list[tuple[str, str]] = []
    for e in align(hyp, ref):
        op = e["op"]
        if op == "match":
            before = None
        elif op == "extra_reference" and "name" in e["key"] and not e["key"].startswith("name"):
            # A placeholder for a name takes the place of one word of the hypothesis, the one before it or the next.
            if kept and kept[-1][0] == "extra_payload":
                kept.pop()
            else:
                expect = True
            before = None
        elif op == "extra_payload" and expect:
            expect = False
            continue
        elif before is not None and before != op:
            before = None  # with the error before it, a substitution: already counted once
        else:
            errors, before = errors + 1, op
        kept.append((op, e["key"]))
    sign = {"match": "  ", "extra_reference": "+ ", "extra_payload": "- "}
    return {"wer": errors / len(reference), "errors": errors, "total": len(reference), "matches": max(0, len(reference) - errors), "diff": "\n".join(sign[op] + key for op, key in kept)}


def word_error_rate(hypothesis: Column, reference: Column) -> Column:
    """D3 as a column over two arrays of words."""

    @F.pandas_udf("struct<wer:double,errors:int,total:int,matches:int,diff:string>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([word_errors(list(x), list(y)) for x, y in zip(a, b, strict=True)], columns=["wer", "errors", "total", "matches", "diff"])

    return run(hypothesis, reference)


def best_window(gold: list[str], main: list[str]) -> tuple[int, int]:
    """C4: the stretch of ``main``, within two words of gold's length, that shares most words with it.

    Counts slide along, so work is in proportion to five times the main text.
    """
    if not gold or not main:
        return 0, 0
    want, best = Counter(gold), None
    for span in range(max(1, len(gold) - 2), min(len(main), len(gold) + 2) + 1):
        have, shared = Counter(), 0
        for k, w in enumerate(main):
            shared += have[w] < want[w]
            have[w] += 1
            if k >= span:
                out = main[k - span]
                have[out] -= 1
                shared -= have[out] < want[out]
            if k >= span - 1:
                rank = (shared, -abs(span - len(gold)), k + 1)
                if best is None or rank > best[0]:
                    best = (rank, (k + 1 - span, k + 1))
    return best[1] if best else (0, min(len(main), len(gold)))


def _flat(utterances: list[dict], kept) -> tuple[list[str], list[tuple]]:
    """The normal forms of all compared words, and for each its utterance, place, place among compared words, and tag."""
    forms, info = [], []
    for u, utterance in enumerate(utterances):
        nth, tags = 0, utterance.get("tags")
        tags = [] if tags is None else list(tags)
        for p, w in enumerate(utterance["words"]):
            if kept(w):
                for y in conform(w):
                    forms.append(y)
                    info.append((u, p, nth, tags[p].upper() if p < len(tags) and tags[p] is not None else None))
                nth += 1
    return forms, info


def compare(main: list[dict], gold: list[dict], kept=lambda w: w.strip() not in PUNCTUATION and w.strip().lower() not in FILLERS) -> list[dict]:
    """Each gold utterance (words, tags, terminator) is aligned within its best window of the main words that are left.

    Returns the tokens that each side's utterances show, in order of their place: words of the other side
    stand half a place behind the word they follow.  A match carries where its words are on both sides.
    """
    words, info = _flat(main, kept)
    shown: list[tuple] = []  # side, utterance, place, then what is returned
    at, anywhere = 0, None
    for u, utterance in enumerate(gold):
        own, places = _flat([utterance], kept)
        if own:
            s, e = (at + x for x in best_window(own, words[at:]))
            start = info[s][:2] if s < len(words) else None
            i, j, here, before = s, 0, None, None
            for edit in align(words[s:e], own, "caseless"):
                token = {"word": edit["key"], "main_utt": None, "main_word": None, "gold_word": None}
                if edit["op"] != "extra_reference":
                    mu, mp, mn, tag = info[i]
                    here = anywhere = (mu, mp)
                    i += 1
                if edit["op"] != "extra_payload":
                    _, gp, gn, gold_tag = places[j]
                    j += 1
                if edit["op"] == "match":
                    token |= {"status": "match", "tag": tag, "main_utt": mu, "main_word": mn, "gold_word": gn}
                    shown += [("main", mu, float(mp), token), ("gold", u, float(gp), token)]
                    before = gp
                elif edit["op"] == "extra_payload":
                    token |= {"status": "extra_main", "tag": tag}
                    shown += [("main", mu, float(mp), token), ("gold", u, -0.5 if before is None else before + 0.5, token)]
                else:
                    token |= {"status": "extra_gold", "tag": gold_tag}
                    shown.append(("gold", u, float(gp), token))
                    if anchor := here or start or anywhere:
                        shown.append(("main", anchor[0], anchor[1] + 0.5, token))
                    before = gp
            at = e
        if utterance.get("terminator"):
            shown.append(("gold", u, float(len(own)), {"word": utterance["terminator"], "tag": "PUNCT", "status": "match", "main_utt": None, "main_word": None, "gold_word": None}))
    out, seq = [], 0
    for side, u, place, token in sorted(shown, key=lambda x: (x[0], x[1], x[2])):  # a stable sort, as ties keep the order they came in
        seq = seq + 1 if out and (out[-1]["side"], out[-1]["utt"]) == (side, u) else 0
        out.append({"side": side, "utt": u, "seq": seq, "place": place, **token})
    return out


def compared(df: DataFrame) -> DataFrame:
    """Rows (f, side, utt, seq, place, status, word, tag, main_utt, main_word, gold_word).

    From rows (f, main, gold), arrays of utterances (words array<string>, tags array<string>, terminator string).
    """
    kind = "array<struct<side:string,utt:int,seq:int,place:double,status:string,word:string,tag:string,main_utt:int,main_word:int,gold_word:int>>"
    listed = lambda us: [{"words": list(u["words"]), "tags": u.get("tags"), "terminator": u.get("terminator")} for u in us]

    made = by_row(lambda main, gold: compare(listed(main), listed(gold)), kind, F.col("main"), F.col("gold"))
    return df.select("f", F.explode(made).alias("t")).select("f", "t.*")


def compare_metrics(tokens: DataFrame) -> DataFrame:
    """D1 over C5's tokens: the gold side's, without its terminators."""
    op = F.when(F.col("status") == "match", "match").when(F.col("status") == "extra_main", "extra_payload").otherwise("extra_reference")
    return edit_metrics(tokens.where("side = 'gold' and coalesce(tag, '') != 'PUNCT'").select("f", op.alias("op")))


def gold_projection(tokens: DataFrame, main: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold utterances (f, utt, tiers) with the tiers that the comparison lets them take from the main transcript.

    ``main`` and ``gold`` have rows (f, utt, n_compared, n_words, mor array<string>, tiers map) of all utterances.  A gold utterance
    all of whose words match all words of one main utterance, and nothing else, takes its ``mor``, ``gra`` and
    ``wor``.  One whose words all match somewhere, each with a word of its own, takes only their ``mor`` items.  Others stay.
    """
    g = tokens.where("side = 'gold'")
    pair = F.struct("main_utt", "main_word")
    hits = g.where("main_utt is not null")
    # A word of several normal forms matches once for each of them in a row; these count as one.
    w = Window.partitionBy("f", "utt").orderBy("seq")
    key = F.struct("main_utt", "main_word", "gold_word")
    hits = hits.withColumn("again", F.coalesce(F.lag(key).over(w) == key, F.lit(False))).where("not again")
    per = hits.groupBy("f", "utt").agg(
        F.count("*").alias("n"), F.count_distinct("gold_word").alias("n_gold"), F.count_distinct(pair).alias("n_main"), F.min("main_utt").alias("first"), F.max("main_utt").alias("last"),
        F.collect_list(F.struct("gold_word", "main_utt", "main_word")).alias("hits"),
    )
    other = g.groupBy("f", "utt").agg(F.bool_and(F.col("status") == "match").alias("only"))
    m = main.select("f", F.col("utt").alias("main_utt"), F.col("n_compared").alias("m_compared"), F.col("n_words").alias("m_words"), F.col("mor").alias("m_mor"), F.col("tiers").alias("m_tiers"))
    out = gold.join(per, ["f", "utt"], "left").join(other, ["f", "utt"], "left").join(m.drop("m_mor").withColumnRenamed("main_utt", "first"), ["f", "first"], "left")
    full = (F.col("n_compared") > 0) & (F.col("n_gold") == F.col("n_compared"))
    exact = full & (F.col("n") == F.col("n_gold")) & (F.col("n_main") == F.col("n")) & (F.col("first") == F.col("last")) & (F.col("m_compared") == F.col("n")) & (F.col("m_words") == F.col("n_words")) & F.col("only")
    out = out.withColumns({"exact": F.coalesce(exact, F.lit(False)), "full": F.coalesce(full & (F.col("n_main") == F.col("n")), F.lit(False))})
    # The items of those that match in full are fetched word by word.
    items = out.where("full and not exact").select("f", "utt", F.explode("hits").alias("h")).select("f", "utt", "h.*").join(m.select("f", "main_utt", "m_mor"), ["f", "main_utt"], "left")
    items = items.groupBy("f", "utt").agg(F.array_sort(F.collect_list(F.struct("gold_word", F.get("m_mor", F.col("main_word")).alias("item")))).alias("items"))
    items = items.select("f", "utt", F.map_from_entries(F.transform("items", lambda x: F.struct(x["gold_word"], x["item"]))).alias("taken"))
    out = out.join(items, ["f", "utt"], "left")
    own = F.when(F.size("mor") == F.col("n_compared"), F.col("mor"))
    mor = F.transform(F.sequence(F.lit(0), F.col("n_compared") - 1), lambda k: F.coalesce(F.col("taken")[k.cast("int")], F.get(own, k.cast("int"))))
    mor = F.when(F.col("full") & ~F.col("exact") & ~F.exists(F.map_values("taken"), lambda x: x.isNull()), F.when(~F.exists(mor, lambda x: x.isNull()), F.array_join(mor, " ")))
    none = F.create_map().cast("map<string,string>")
    mine = F.coalesce("tiers", none)
    copied = F.map_filter(F.coalesce("m_tiers", none), lambda k, _: k.isin("mor", "gra", "wor"))
    put = lambda new: F.map_concat(F.map_filter(mine, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    return out.select("f", "utt", F.when(F.col("exact"), put(copied)).when(mor.isNotNull(), put(F.create_map(F.lit("mor"), mor))).otherwise(mine).alias("tiers"))


def transcript_diff(before: list[dict], after: list[dict]) -> list[dict]:
    """What became of each utterance (speaker, text, timing), in the order of the later text; deletions come last."""
    edits = align([u["text"] for u in after], [u["text"] for u in before])
    out, gone, k = [], [], 0
    while k < len(edits):
        e = edits[k]
        nxt = edits[k + 1] if k + 1 < len(edits) else None
        if e["op"] == "match":
            x, y = before[e["reference_idx"]], after[e["payload_idx"]]
            kind = "speaker_changed" if x["speaker"] != y["speaker"] else "timing_only" if x["timing"] != y["timing"] else "unchanged"
            out.append({"kind": kind, "before_idx": e["reference_idx"], "after_idx": e["payload_idx"], "timing_changed": x["timing"] != y["timing"]})
        elif nxt and nxt["op"] != "match" and nxt["op"] != e["op"]:
            p, r = (e, nxt) if e["op"] == "extra_payload" else (nxt, e)
            out.append({"kind": "words_changed", "before_idx": r["reference_idx"], "after_idx": p["payload_idx"], "timing_changed": before[r["reference_idx"]]["timing"] != after[p["payload_idx"]]["timing"]})
            k += 1
        elif e["op"] == "extra_payload":
            out.append({"kind": "inserted", "before_idx": None, "after_idx": e["payload_idx"], "timing_changed": False})
        else:
            gone.append({"kind": "deleted", "before_idx": e["reference_idx"], "after_idx": None, "timing_changed": False})
        k += 1
    return out + gone


def diffed(df: DataFrame) -> DataFrame:
    """Rows (f, kind, before_idx, after_idx, timing_changed) from rows (f, before, after), arrays of (speaker, text, timing)."""

    made = by_row(transcript_diff, "array<struct<kind:string,before_idx:int,after_idx:int,timing_changed:boolean>>", F.col("before"), F.col("after"))
    return df.select("f", F.explode(made).alias("t")).select("f", "t.*")


def diff_summary(deltas: DataFrame) -> DataFrame:
    """How many utterances of each kind of change a file has."""
    kinds = ("unchanged", "words_changed", "timing_only", "speaker_changed", "inserted", "deleted")
    return deltas.groupBy("f").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def _letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def stitch(words: list[str], tokens: list[dict], offset_ms: int = 0, pauses: bool = True) -> list[tuple[int, int] | None]:
    """C14: the times of words that tokens (text, time_s) spell one after another; from the first that they do not spell on, none.

    A word without letters or digits leaves all untimed; tokens without any, and markers ``<|…|>``, are passed over.
    With ``pauses`` a word lasts to the next token's start (the last one half a second), otherwise its end is its start.
    """
    want = [_letters(w) for w in words]
    if not all(want):
        return [None] * len(words)
    own = [t for t in tokens if not (t["text"].strip().startswith("<|") and t["text"].strip().endswith("|>"))]
    spelled = [(x, int(t["time_s"] * 1000) + offset_ms) for t in own if (x := _letters(t["text"]))]
    out: list[tuple[int, int] | None] = []
    at = 0
    for w in want:
        first, got = at, ""
        while at < len(spelled) and got != w and w.startswith(got + spelled[at][0]):
            got, at = got + spelled[at][0], at + 1
        if got != w:
            break
        start = spelled[first][1]
        nxt = spelled[at][1] if at < len(spelled) else start + 500
        out.append((start, max(nxt, start + 1) if pauses else start))
    return out + [None] * (len(words) - len(out))


def stitched(df: DataFrame, pauses: bool = True) -> DataFrame:
    """C14: rows (f, g, p, start_ms, end_ms) from rows (f, g, words array<string>, tokens array<struct<text, time_s>>, offset_ms)."""

    def times(words: list[str], tokens: list[dict], offset: int) -> list[dict | None]:
        return [None if x is None else {"start_ms": x[0], "end_ms": x[1]} for x in stitch(words, tokens, offset, pauses)]

    made = by_row(times, "array<struct<start_ms:bigint,end_ms:bigint>>", F.col("words"), F.col("tokens"), F.col("offset_ms"))
    return df.select("f", "g", F.posexplode(made).alias("p", "t")).select("f", "g", "p", "t.*")


def length_mapping(n_words: Column, n_tokens: Column) -> Column:
    """C17: tokens of each word by position alone, at least one each."""
    w, t = n_words, n_tokens
    start = lambda k: F.floor(k * t / w).cast("int")
    one = lambda k: F.sequence(start(k), F.greatest(start(k + 1), F.least(start(k) + 1, t)) - 1)
    return F.when((w > 0) & (t > 0), F.transform(F.sequence(F.lit(0), w - 1), one)).otherwise(F.transform(F.array_repeat(F.lit(0), w), lambda _: F.array().cast("array<int>")))


def utterance_groups(ranges: list[list[int]], n: int, least: int = 3) -> list[int]:
    """An utterance number for each of ``n`` words from phrase ranges; groups under ``least`` words join the next."""
    if n <= 1:
        return [0] * n
    taken: set[int] = set()
    phrases: list[list[int]] = []
    for r in [*reversed(sorted(ranges, key=len)), list(range(n))]:
        own = sorted(set(r) - taken)
        if own:
            taken |= set(own)
            phrases.append(own)
    of = {i: k for k, p in enumerate(reversed(phrases)) if len(p) > 1 for i in p if i < n}
    if not of:
        return [0] * n
    last = max(of)
    filled = [of[next((j for j in range(i, n) if j in of), last)] for i in range(n)]
    sizes = [len(list(g)) for _, g in groupby(filled)]
    merged, pending = [], 0
    for s in sizes:
        pending += s
        if s >= least:
            merged.append(pending)
            pending = 0
    if pending:
        merged[-1:] = [(merged[-1] if merged else 0) + pending]
    return [k for k, s in enumerate(merged) for _ in range(s)]


def chinese_number(n: int, traditional: bool = False) -> str:
    """H4: a number in Chinese characters, by groups of four digits."""
    if n == 0:
        return "零"
    digits, small = "零一二三四五六七八九", ("", "十", "百", "千")
    large = ("", *("萬億兆京垓秭穰溝澗正載" if traditional else "万亿兆京垓秭穰沟涧正载"))
    text = str(n)
    cuts = [0, *range(len(text) % 4 or 4, len(text) + 1, 4)]
    out, empty = "", False
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if not int(text[a:b]):
            empty = True  # a zero stands for it before the next group
            continue
        out += "零" if empty else ""
        group, gap, empty = "", False, False
        for place, c in zip(range(b - a - 1, -1, -1), text[a:b], strict=True):
            if c == "0":
                gap = bool(out or group)
            else:
                one = c == "1" and place == 1 and not group and not out
                group += ("零" if gap else "") + ("" if one else digits[int(c)]) + small[place]
                gap = False
        out += group + large[len(cuts) - 2 - k]
    return out


def chinese_numbers(n: Column, traditional: bool = False) -> Column:
    """H4 as a column."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else chinese_number(int(v), traditional))

    return run(n)


def reusable_words(words: DataFrame) -> DataFrame:
    """Rows (f, u, reusable): every word is timed, and there are as many as the utterance has."""
    return words.groupBy("f", "u").agg((F.bool_and(F.col("a").isNotNull()) & (F.count("*") == F.max("n_words"))).alias("reusable"))


def diarization_line(line: Column) -> Column:
    """(speaker, start_ms, end_ms) of a line of speaker segments; null for other lines."""
    p = F.split(F.trim(line), r"\s+")
    start, length = F.get(p, 3).try_cast("double"), F.get(p, 4).try_cast("double")
    made = F.struct(F.get(p, 7).alias("speaker"), F.round(start * 1000).cast("long").alias("start_ms"), F.round((start + length) * 1000).cast("long").alias("end_ms"))
    return F.when((F.get(p, 0) == "SPEAKER") & start.isNotNull() & length.isNotNull(), made)


def audio_identity(path: Column, modified: Column, size: Column) -> Column:
    """What an audio file is known by."""
    return F.concat_ws("|", path, modified, size)


def tree_ranges(tree: str) -> list[list[int]]:
    """Word places below each clause that is coordinated with others, from a bracketed tree, outer clauses first.

    A clause counts if its label is ``S`` and a sibling is a conjunction (``CC`` or ``CONJ``, in any case).
    """
    stack: list[list] = [["", [], 0]]  # label, children as (label, begin, end, ranges below), words before it
    at, roots = 0, 0
    for tok in re.findall(r"[()]|[^\s()]+", tree):
        if tok == "(":
            roots += len(stack) == 1
            stack.append([None, [], at])
        elif tok == ")":
            if len(stack) < 2:
                raise ValueError("a bracket closes that none opened")
            label, kids, begin = stack.pop()
            joined = any(k.lower() in ("cc", "conj") for k, *_ in kids)
            below = [r for k, b, e, inner in kids for r in ([list(range(b, e))] if joined and k == "S" else []) + inner]
            stack[-1][1].append((label or "", begin, at, below))
        elif stack[-1][0] is None:
            stack[-1][0] = tok
        else:
            at += 1
    if len(stack) != 1:
        raise ValueError("a bracket is left open")
    if roots != 1 or len(stack[0][1]) != 1:
        raise ValueError("not one bracketed tree")
    return stack[0][1][0][3]


def utterance_groups_of(trees: Column, n_words: Column) -> Column:
    """E14 as a column: an utterance number for each word, from an array of bracketed trees; trees that can't be read are left out."""

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for row, k in zip(rows, n, strict=True):
            ranges: list[list[int]] = []
            for tree in row if row is not None else []:
                try:
                    ranges += tree_ranges(tree)
                except ValueError:
                    continue
            out.append(utterance_groups(ranges, int(k)))
        return pd.Series(out)

    return run(trees, n_words)


def merged_letters(words: list[str], known: frozenset) -> list[str]:
    """Runs of single letters that spell a known abbreviation in capitals become one word as they are written, the longest first."""
    longest, out, k = max(map(len, known), default=0), [], 0
    while k < len(words):
        size = next((n for n in range(min(longest, len(words) - k), 1, -1) if all(len(w) == 1 and w.isalpha() for w in words[k : k + n]) and "".join(words[k : k + n]).upper() in known), 1)
        out.append("".join(words[k : k + size]))
        k += size
    return out


def letters_merged(words: Column, known: frozenset) -> Column:
    """E15 as a column over arrays of words."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ws: None if ws is None else merged_letters(list(ws), known))

    return run(words)


# Signs of currencies, before or behind a number.
BEFORE_NUMBER = {"$": "dollars", "€": "euros", "£": "pounds", "¥": "yen", "₹": "rupees", "₩": "won", "₽": "rubles"}
BEHIND_NUMBER = {"€": "euros", "₹": "rupees"}
#: Languages whose numbers are written in simplified or traditional characters.
SIMPLIFIED, TRADITIONAL = ("zho", "cmn"), ("jpn", "yue")


def spoken_number(n: int, table: dict[int, str]) -> str | None:
    """H3: a number in words, from a language's table of values, the largest first; a value from a hundred on takes a spoken multiplier.

    None for a number that the table can't reach.
    """
    if n == 0:
        return table.get(0)
    parts = []
    for value in sorted((v for v in table if v > 0), reverse=True):
        if value > n:
            continue
        if value >= 100:
            times, n = divmod(n, value)
            head = "" if times == 1 else spoken_number(times, table)
            if head is None:
                return None
            parts.append(f"{head} {table[value]}".strip())
        else:
            parts.append(table[value])
            n -= value
        if not n:
            return " ".join(parts)
    return None


def expanded_number(word: str, table: dict[int, str], lang: str = "eng") -> str:
    """H2: a word of digits, of groups of digits between dashes, or of digits with a currency's sign, in words; others as they are."""

    def spoken(digits: str) -> str:
        if lang.lower() in SIMPLIFIED + TRADITIONAL:
            return chinese_number(int(digits), lang.lower() in TRADITIONAL)
        own = table.get(int(digits)) if str(int(digits)) == digits else None
        return own or spoken_number(int(digits), table) or digits

    is_number = lambda x: bool(x) and x.isascii() and x.isdigit()
    plain = word.replace("—", "-").replace("–", "-")
    parts = plain.split("-")
    if len(parts) > 1 and all(map(is_number, parts)):
        return " ".join(map(spoken, parts))
    for signs, rest in ((BEFORE_NUMBER, plain[1:]), (BEHIND_NUMBER, plain[:-1])):
        name = signs.get(plain[:1] if signs is BEFORE_NUMBER else plain[-1:])
        if name and is_number(rest.strip()):
            return f"{spoken(rest.strip())} {name}"
    return spoken(plain) if is_number(plain) else plain


def spoken_numbers(words: Column, table: dict[int, str], lang: str = "eng") -> Column:
    """H2 as a column over arrays of words."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ws: None if ws is None else [expanded_number(w, table, lang) for w in ws])

    return run(words)

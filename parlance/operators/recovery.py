"""Timing of utterances recovered from recognised tokens.

A file is one row: ``utterances``, an array of (u, speaker, words, start_ms, end_ms, lazy,
bottoms, tops), and ``tokens``, an array of (text, start_ms, end_ms).  ``lazy`` marks an
utterance that overlaps the one before; ``bottoms`` are the numbers of its overlap marks, and
``tops`` the numbers of marks that others overlap, with the share of words before each.
Alignment is over whole files, so a file is the unit of work and no rows are gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from parlance.functions.slices import by_row
from parlance.operators.align import _fold, align
from parlance.operators.timing import group_by_duration

Bullet = tuple[int, int] | None
UTTERANCES = "array<struct<u:int,speaker:string,words:array<string>,start_ms:bigint,end_ms:bigint,lazy:boolean,bottoms:array<int>,tops:array<struct<number:int,fraction:double>>>>"
TOKENS = "array<struct<text:string,start_ms:bigint,end_ms:bigint>>"


@dataclass(frozen=True)
class TwoPass:
    """Settings of the two-pass recovery."""

    overlap_marks: bool = True
    most_excluded: float = 0.3
    tight_ms: int = 500
    mode: str = "fuzzy"
    threshold: float = 0.85


def unique_places(words: list[str], tokens: list[str]) -> list[int] | None:
    """Where each word is among the tokens if all are there in order in one way only, else None.

    The earliest places, found from the front, are then the latest ones, found from the back.
    """

    def sought(need: list[bytes], among: list[bytes]) -> list[int]:
        out, k = [], 0
        for w in need:
            while k < len(among) and among[k] != w:
                k += 1
            if k == len(among):
                return []
            out.append(k)
            k += 1
        return out

    need, among = [_fold(w) for w in words], [_fold(t) for t in tokens]
    first = sought(need, among)
    if len(first) < len(need):
        return None
    last = [len(among) - 1 - k for k in sought(need[::-1], among[::-1])][::-1]
    return first if first == last else None


def matched_ranges(words: list[str], owners: list[int], tokens: list[str], mode: str, threshold: float) -> dict[int, tuple[int, int]]:
    """For each utterance its first and last matched token: from the only way to embed the words, or else an alignment."""
    places = unique_places(words, tokens) if mode != "fuzzy" else None
    pairs = enumerate(places) if places is not None else ((e["payload_idx"], e["reference_idx"]) for e in align(words, tokens, mode, threshold) if e["op"] == "match")
    out: dict[int, tuple[int, int]] = {}
    for i, j in pairs:
        low, high = out.get(owners[i], (j, j))
        out[owners[i]] = (min(low, j), max(high, j))
    return out


def global_pass(utterances: list[dict], tokens: list[dict], mode: str = "caseless", threshold: float = 0.85, skip: frozenset = frozenset()) -> list[Bullet]:
    """Bullets of all utterances: their own, or the span of the tokens that their words matched; those in ``skip`` take no part."""
    own: list[Bullet] = [None if u["start_ms"] is None else (u["start_ms"], u["end_ms"]) for u in utterances]
    if not tokens:
        return own
    flat = [(w, k) for k, u in enumerate(utterances) if k not in skip for w in u["words"]]
    spans = matched_ranges([w for w, _ in flat], [k for _, k in flat], [t["text"] for t in tokens], mode, threshold)
    return [b if b or k not in spans else (tokens[spans[k][0]]["start_ms"], tokens[spans[k][1]]["end_ms"]) for k, b in enumerate(own)]


def onset_fraction(k: int, utterances: list[dict], timed: list[bool]) -> float | None:
    """Where in a predecessor utterance ``k`` begins to overlap, as a share of its words.

    Looking back over other speakers up to the first timed one, the nearest top mark whose number is
    among the utterance's bottom marks counts, or any top for an utterance without them; that one
    then also takes the least top of the nearest utterance that has one, up to the first timed one.
    """
    me, numbers = utterances[k], set(utterances[k]["bottoms"])
    for j in range(k - 1, -1, -1):
        u = utterances[j]
        if u["speaker"] != me["speaker"]:
            for top in u["tops"]:
                if not numbers or top["number"] in numbers:
                    return top["fraction"]
            if timed[j]:
                break
    if not numbers:
        for j in range(k - 1, -1, -1):
            if utterances[j]["tops"]:
                return min(t["fraction"] for t in utterances[j]["tops"])
            if timed[j]:
                break
    return None


def windowed(words: list[str], tokens: list[dict], low: int, high: int, mode: str, threshold: float) -> Bullet:
    """The span of the tokens within a window (C7) that an utterance's words match."""
    near = [t for t in tokens if t["start_ms"] < high and t["end_ms"] > low]
    hits = [near[e["reference_idx"]] for e in align(words, [t["text"] for t in near], mode, threshold) if e["op"] == "match"] if near else []
    return (min(t["start_ms"] for t in hits), max(t["end_ms"] for t in hits)) if hits else None


def two_passes(utterances: list[dict], tokens: list[dict], config: TwoPass) -> list[Bullet]:
    """C11: overlapping utterances stay out of the first pass unless they are too many, and are then sought near their predecessors.

    Windows grow from tight to the predecessor's length and twice that, and the first match counts.
    """
    marked = [bool(u["lazy"]) or config.overlap_marks and bool(u["bottoms"]) for u in utterances]
    few = sum(marked) <= config.most_excluded * len(utterances)
    skip = frozenset(k for k, u in enumerate(utterances) if u["lazy"] or u["bottoms"]) if few else frozenset()
    bullets = global_pass(utterances, tokens, config.mode, config.threshold, skip)
    if not tokens:
        return bullets
    timed, out = [b is not None for b in bullets], list(bullets)
    for k, u in enumerate(utterances):
        before = next((b for b in reversed(bullets[:k]) if b), None)
        if not marked[k] or bullets[k] or not u["words"] or before is None:
            continue
        start, end = before
        length = max(0, end - start)
        share = onset_fraction(k, utterances, timed) if config.overlap_marks else None
        anchor = start if share is None else start + int(share * length)
        for buffer in (config.tight_ms, max(length, 2000), max(2 * length, 5000)):
            found = windowed(list(u["words"]), tokens, max(0, anchor - buffer), end + buffer, config.mode, config.threshold)
            if found:
                out[k] = found
                break
    return out


def _rows(utterances, bullets: list[Bullet]) -> list[dict]:
    return [{"u": u["u"], "start_ms": b and b[0], "end_ms": b and b[1], "had": u["start_ms"] is not None, "n_words": len(u["words"])} for u, b in zip(utterances, bullets, strict=True)]


_BULLETS = "array<struct<u:int,start_ms:bigint,end_ms:bigint,had:boolean,n_words:int>>"


def _plain(rows) -> list[dict]:
    """Structs of utterances with empty lists for null ones."""
    return [{**r, **{k: [] if r[k] is None else r[k] for k in ("words", "bottoms", "tops")}} for r in rows]


def recovered_timing(df: DataFrame, mode: str = "caseless", threshold: float = 0.85) -> DataFrame:
    """Rows (f, u, start_ms, end_ms, had, n_words): every utterance with its bullet after one global pass; ``had`` if it had one."""

    def one(utterances: list[dict], tokens: list[dict]) -> list[dict]:
        return _rows(u := _plain(utterances), global_pass(u, tokens, mode, threshold))

    return df.select("f", F.explode(by_row(one, _BULLETS, F.col("utterances"), F.col("tokens"))).alias("t")).select("f", "t.*")


def recovery_counts(bullets: DataFrame) -> DataFrame:
    """Rows (f, injected, skipped, unmatched): utterances that got a bullet, had one, or have none."""
    got = F.col("start_ms").isNotNull()
    return bullets.groupBy("f").agg(F.count_if(got & ~F.col("had")).alias("injected"), F.count_if("had").alias("skipped"), F.count_if(~got).alias("unmatched"))


def needs_two_passes(utterances: DataFrame) -> DataFrame:
    """Files with a lazy overlap or an overlap mark."""
    return utterances.groupBy("f").agg(F.bool_or(F.col("lazy_overlap") | F.contains("text", F.lit("⌊"))).alias("two_pass"))


def two_pass_timing(df: DataFrame, config: TwoPass = TwoPass(), total_ms: int | None = None, most_ms: int | None = None) -> DataFrame:  # noqa: B008
    """C11: rows (f, u, start_ms, end_ms, had, n_words, two_pass): the better of two passes and one.

    With the audio's length and the longest group given, the way that makes more groups (E5) is better; at a tie, and
    without them, the one that times at least as many utterances, two passes first.
    """

    def both_ways(utterances: list[dict], tokens: list[dict]) -> dict[str, list[dict]]:
        u = _plain(utterances)
        return {"one": _rows(u, global_pass(u, tokens, config.mode, config.threshold)), "two": _rows(u, two_passes(u, tokens, config))}

    both = df.select("f", by_row(both_ways, f"struct<one:{_BULLETS},two:{_BULLETS}>", F.col("utterances"), F.col("tokens")).alias("r"))
    way = lambda name, two: both.select("f", F.lit(two).alias("two_pass"), F.explode(f"r.{name}").alias("t")).select("f", "two_pass", "t.*")
    rows = way("one", False).union(way("two", True))
    score = rows.groupBy("f").agg(F.count_if(F.col("two_pass") & F.col("start_ms").isNotNull()).alias("two"), F.count_if(~F.col("two_pass") & F.col("start_ms").isNotNull()).alias("one"))
    better = F.col("two") >= F.col("one")
    if total_ms is not None and most_ms is not None:
        # Both ways are grouped at once, as files of their own.
        files = rows.select((F.col("f") * 2 + F.col("two_pass").cast("int")).cast("long").alias("f"), F.col("u").cast("long").alias("i"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), F.col("n_words").cast("long").alias("w"))
        groups = group_by_duration(files, most_ms, total_ms).groupBy("f").agg(F.count_distinct("grp").alias("n"))
        n = groups.groupBy(F.floor(F.col("f") / 2).cast("long").alias("f")).agg(F.coalesce(F.max(F.when(F.col("f") % 2 == 1, F.col("n"))), F.lit(0)).alias("g2"), F.coalesce(F.max(F.when(F.col("f") % 2 == 0, F.col("n"))), F.lit(0)).alias("g1"))
        score = score.join(n, "f", "left").na.fill(0, ["g1", "g2"])
        better = F.when(F.col("g2") != F.col("g1"), F.col("g2") > F.col("g1")).otherwise(better)
    return rows.join(score.select("f", better.alias("better")), "f").where("two_pass = better").select("f", "u", "start_ms", "end_ms", "had", "n_words", "two_pass")


def recover(df: DataFrame, strategy: str = "auto", config: TwoPass = TwoPass(), total_ms: int | None = None, most_ms: int | None = None) -> DataFrame:  # noqa: B008
    """Rows (f, u, start_ms, end_ms) by a strategy: ``global``, ``two_pass``, or ``auto``, two passes for files with an overlap."""
    names = ("f", "u", "start_ms", "end_ms")
    if strategy == "global":
        return recovered_timing(df).select(*names)
    if strategy == "two_pass":
        return two_pass_timing(df, config, total_ms, most_ms).select(*names)
    overlap = F.exists("utterances", lambda u: F.coalesce(u["lazy"], F.lit(False)) | (F.coalesce(F.size(u["bottoms"]), F.lit(0)) > 0))
    return recovered_timing(df.where(~overlap)).select(*names).union(two_pass_timing(df.where(overlap), config, total_ms, most_ms).select(*names))


def overlap_onsets(df: DataFrame) -> DataFrame:
    """Rows (f, u, prev_start, prev_end, onset): the nearest timed predecessor's bullet and where in it each utterance begins to overlap."""

    def onsets(utterances: list[dict]) -> list[dict]:
        rows = _plain(utterances)
        timed = [u["start_ms"] is not None for u in rows]
        return [{"u": u["u"], "start_ms": u["start_ms"], "end_ms": u["end_ms"], "onset": onset_fraction(k, rows, timed)} for k, u in enumerate(rows)]

    made = by_row(onsets, "array<struct<u:int,start_ms:bigint,end_ms:bigint,onset:double>>", F.col("utterances"))
    rows = df.select("f", F.explode(made).alias("t")).select("f", "t.*")
    w = Window.partitionBy("f").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("start_ms").isNotNull(), F.struct("start_ms", "end_ms")), ignorenulls=True).over(w)
    return rows.withColumn("p", last).select("f", "u", F.col("p.start_ms").alias("prev_start"), F.col("p.end_ms").alias("prev_end"), "onset")

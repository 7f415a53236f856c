"""Operators on time-stamped utterances and words.

Rows carry a file ``f``, an ordinal ``i`` within it, and a start ``a`` and end ``b`` in
milliseconds, both null where untimed.  Every window is partitioned by file, so a file is
the largest group that one task holds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed values in milliseconds: tolerated overlap of one speaker, padding of estimates, and the end of a last untimed word.
OVERLAP_MS, PAD_MS, LAST_WORD_MS = 500, 2000, 500

_BEFORE = (Window.unboundedPreceding, -1)


def _next(column: str, *keys: str) -> Column:
    """The first value that is not null after a row: a running ``last`` against the order, as a frame that looks ahead is read anew for each row."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(*_BEFORE))


def monotonic(df: DataFrame) -> DataFrame:
    """Adds ``stripped``, true for a start before the greatest start so far; its times become null."""
    w = Window.partitionBy("f").orderBy("i").rowsBetween(*_BEFORE)
    back = F.coalesce(F.col("a") < F.max("a").over(w), F.lit(False))
    df = df.withColumn("stripped", back)
    return df.withColumns({c: F.when(~F.col("stripped"), F.col(c)) for c in ("a", "b")})


def same_speaker_overlap(df: DataFrame, tolerance: int = OVERLAP_MS) -> DataFrame:
    """Adds ``stripped``, true where a timed row ends past the speaker's next start by more than the tolerance."""
    timed = F.col("a").isNotNull()
    w = Window.partitionBy("f", "speaker", timed).orderBy("i")
    over = F.coalesce(timed & (F.col("b") > F.lead("a").over(w) + tolerance), F.lit(False))
    df = df.withColumn("stripped", over)
    return df.withColumns({c: F.when(~F.col("stripped"), F.col(c)) for c in ("a", "b")})


def _gaps(df: DataFrame, total_ms: int) -> DataFrame:
    w = Window.partitionBy("f").orderBy("i")
    return df.withColumns(
        {
            "gap_start": F.coalesce(F.last("b", ignorenulls=True).over(w.rowsBetween(*_BEFORE)), F.lit(0)),
            "gap_end": F.coalesce(_next("a", "f"), F.lit(total_ms)),
            "run": F.count("a").over(w),
        }
    )


def estimate_untimed(df: DataFrame, total_ms: int, pad: int = PAD_MS) -> DataFrame:
    """Adds ``est_start`` and ``est_end``; untimed rows share the gap around them by their words ``w``, padded and clamped."""
    run = Window.partitionBy("f", "run", F.col("a").isNull())
    df = _gaps(df, total_ms).withColumns({"run_words": F.sum("w").over(run), "words_before": F.coalesce(F.sum("w").over(run.orderBy("i").rowsBetween(*_BEFORE)), F.lit(0))})
    width = F.greatest(F.col("gap_end") - F.col("gap_start"), F.lit(0))
    at = lambda n: F.col("gap_start") + F.floor(n / F.col("run_words") * width).cast("long")
    none = F.col("run_words") == 0
    start = F.when(none, F.col("gap_start")).otherwise(F.greatest(at(F.col("words_before")) - pad, F.lit(0)))
    end = F.when(none, F.col("gap_start")).otherwise(F.least(at(F.col("words_before") + F.col("w")) + pad, F.lit(total_ms)))
    df = df.withColumns({"est_start": F.coalesce("a", start).cast("long"), "est_end": F.coalesce("b", end).cast("long")})
    return df.drop("gap_start", "gap_end", "run", "run_words", "words_before")


def untimed_windows(df: DataFrame, total_ms: int, pad: int = 500) -> DataFrame:
    """Rows (f, win_start, win_end): padded gaps of untimed runs, merged where they touch."""
    raw = _gaps(df, total_ms).where("a is null").groupBy("f", "run").agg(
        F.greatest(F.min("gap_start") - pad, F.lit(0)).alias("s"), F.least(F.min("gap_end") + pad, F.lit(total_ms)).alias("e")
    )
    w = Window.partitionBy("f").orderBy("s", "run")
    fresh = ~F.coalesce(F.col("s") <= F.max("e").over(w.rowsBetween(*_BEFORE)), F.lit(False))
    merged = raw.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(w))
    return merged.groupBy("f", "island").agg(F.min("s").alias("win_start"), F.max("e").alias("win_end")).drop("island")


def continuous_ends(df: DataFrame, group: str = "u") -> DataFrame:
    """Adds ``end``: each timed word lasts to the next timed start; the last keeps its end, or gets the utterance's ``ub`` or a default."""
    following = _next("a", "f", group)
    last = F.when(F.col("a") == F.col("b"), F.when(F.col("ub") > F.col("a"), F.col("ub")).otherwise(F.col("a") + LAST_WORD_MS)).otherwise(F.col("b"))
    return df.withColumn("end", F.when(F.col("a").isNotNull(), F.coalesce(following, last)))


def clamp_to_utterance(df: DataFrame, start: str = "a", end: str = "end") -> DataFrame:
    """Adds ``start2`` and ``end2`` within the utterance's ``ua`` and ``ub``; null where nothing is left."""
    s, e = F.greatest(start, "ua"), F.least(end, "ub")
    keep = F.col(start).isNotNull() & (F.col("ua").isNull() | (s < e))
    return df.withColumns({"start2": F.when(keep, s), "end2": F.when(keep, e)})


def utterance_bullets(words: DataFrame, bullets: DataFrame) -> DataFrame:
    """Rows (f, u, start_ms, end_ms): the span of an utterance's words, united with its bullet (never smaller)."""
    spans = words.groupBy("f", "u").agg(F.min("a").alias("s"), F.max("b").alias("e"))
    both = bullets.join(spans, ["f", "u"], "left")
    return both.select("f", "u", F.least("s", "bullet_start").alias("start_ms"), F.greatest("e", "bullet_end").alias("end_ms"))


def timed_counts(df: DataFrame) -> DataFrame:
    """Timed and untimed utterances of each file."""
    return df.groupBy("f").agg(F.count_if(F.col("a").isNotNull()).alias("timed"), F.count_if(F.col("a").isNull()).alias("untimed"))


def overlap_join(tokens: DataFrame, windows: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Rows (f, win, tok): tokens (f, tok, start, end) that overlap windows (f, win, ws, we).

    Both sides are exploded into the time buckets that they touch, so the join is an
    equality on file and bucket; a pair is kept in the first bucket that both touch.
    """
    spread = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket_ms), F.floor(F.greatest(F.col(e), F.col(s)) / bucket_ms)))
    t = tokens.select("f", "tok", "start", "end", spread("start", "end").alias("bucket"))
    w = windows.select("f", "win", "ws", "we", spread("ws", "we").alias("bucket"))
    met = t.join(w, ["f", "bucket"]).where((F.col("start") < F.col("we")) & (F.col("end") > F.col("ws")))
    first = F.greatest(F.floor(F.col("start") / bucket_ms), F.floor(F.col("ws") / bucket_ms))
    return met.where(F.col("bucket") == first).select("f", "win", "tok")


def speaker_as_of(utterances: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows (f, i, speaker): the last listed segment that ends by the utterance's end, else the first segment.

    Utterances and segments (f, seg_idx, seg_end, speaker) are merged in one window by
    time; a running maximum of (seg_idx, speaker) replaces a join of all pairs.
    """
    first = segments.groupBy("f").agg(F.min_by("speaker", "seg_idx").alias("first_speaker"))
    s = segments.select("f", F.col("seg_end").alias("t"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("i"), F.struct("seg_idx", "speaker").alias("seg"))
    u = utterances.select("f", F.col("b").alias("t"), F.lit(1).alias("o"), F.col("i").cast("long").alias("i"), F.lit(None).cast(s.schema["seg"].dataType).alias("seg"))
    w = Window.partitionBy("f").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    got = s.union(u).withColumn("best", F.max("seg").over(w)).where("o = 1")
    return got.join(first, "f", "left").select("f", "i", F.coalesce("best.speaker", "first_speaker").alias("speaker"))


def predecessor_end(df: DataFrame) -> DataFrame:
    """Adds ``prev_end``, the end of the nearest timed row before."""
    w = Window.partitionBy("f").orderBy("i").rowsBetween(*_BEFORE)
    return df.withColumn("prev_end", F.last("b", ignorenulls=True).over(w))


def group_by_duration(df: DataFrame, most_ms: int, total_ms: int | None = None) -> DataFrame:
    """E5: adds ``grp``: consecutive rows, a new group where the span would pass ``most_ms`` or the row ends by the group's start.

    Untimed rows take their estimates (E3) if the audio's length ``total_ms`` is given, and are left out otherwise.  Rows
    without words (``w`` = 0) lengthen a group but do not begin one, and a group without words is left out.  The reset
    depends on where the group began, so rows of a file are folded in order.
    """
    if total_ms is not None:
        df = estimate_untimed(df, total_ms).withColumns({"a": F.coalesce("a", "est_start"), "b": F.coalesce("b", "est_end")})
    kept = df.where("a is not null and b is not null").select("f", "i", "a", "b", "w")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i", ignore_index=True)
        out, group, start, words = [], 0, 0, 0
        for a, b, w in rows[["a", "b", "w"]].itertuples(index=False):
            if words and (b <= start or b - start > most_ms):
                group, words = group + 1, 0
            if not words:
                start = a
            words += w
            out.append(group)
        rows = rows.assign(grp=out)
        return rows if words else rows[rows["grp"] < group]

    return kept.groupBy("f").applyInPandas(fold, "f long, i long, a long, b long, w long, grp int")


def budget_windows(df: DataFrame, budget: int) -> DataFrame:
    """Adds ``win``: consecutive files whose counts ``n`` stay within the budget; a file above it stands alone.

    Folded within each ``part``, in order of ``i``.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i", ignore_index=True)
        out, win, total = [], 0, 0
        for k, n in enumerate(rows["n"].tolist()):
            if k and out[-1] == win and total + n > budget:
                win, total = win + 1, 0
            total += n
            out.append(win)
        return rows.assign(win=out)

    return df.select("part", "i", "n").groupBy("part").applyInPandas(fold, "part long, i long, n long, win int")


def positional_timings(df: DataFrame) -> DataFrame:
    """Adds ``timed``: words zipped with timings by place; lists of different lengths are an error."""
    same = F.assert_true(F.size("words") == F.size("timings"), "as many timings as words are needed")
    zipped = F.zip_with("words", "timings", lambda w, t: F.struct(w.alias("word"), t.alias("ms")))
    return df.withColumn("timed", F.when(same.isNull(), zipped))

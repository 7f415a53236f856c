"""Joins and projections over files, tiers, timings and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from parlance.sources.chat import utterance_lines


def timed_elements(df: DataFrame) -> DataFrame:
    """Recognised elements (f, i, value, ts, end_ts in seconds) without blanks and marks such as ``<pause>``, trimmed, in milliseconds; times that do not advance are null."""
    value = F.regexp_replace("value", r"^\s+|\s+$", "")
    kept = df.withColumn("value", value).where((F.col("value") != "") & ~(F.startswith("value", F.lit("<")) & F.endswith("value", F.lit(">"))))
    ms = lambda c: F.when(~F.isnan(c) & (F.abs(c) < 9e15), F.round(F.col(c) * 1000).cast("long"))
    good = F.coalesce(ms("end_ts") > ms("ts"), F.lit(False))
    return kept.select("f", "i", "value", F.when(good, ms("ts")).alias("start_ms"), F.when(good, ms("end_ts")).alias("end_ms"))


def violations(lines: DataFrame) -> DataFrame:
    """Rows (file_id, line_idx, level, problem) from parsed lines (A1): all that is wrong at each level.

    Level 0: lines that can't be read.  Level 1: no participants, no languages, an utterance without a terminator
    (unless the ``CA`` option is set), an undeclared speaker.  Level 2: an utterance with nothing on its main tier.
    """
    files = lines.groupBy("file_id").agg(
        F.coalesce(F.max(F.when((F.col("kind") == "header") & (F.col("key") == "Participants"), F.col("value"))), F.lit("")).alias("participants"),
        F.coalesce(F.max(F.when((F.col("kind") == "header") & (F.col("key") == "Languages"), F.col("value"))), F.lit("")).alias("languages"),
        F.coalesce(F.bool_or((F.col("kind") == "header") & (F.col("key") == "Options") & F.array_contains(F.split("value", r",\s*"), "CA")), F.lit(False)).alias("ca"),
    )
    codes = F.transform(F.split("participants", r"\s*,\s*"), lambda p: F.substring_index(F.trim(p), " ", 1))
    blank = lambda c: F.trim(c) == ""
    found = lambda level, problem: [F.lit(level).alias("level"), F.lit(problem).alias("problem")]
    none = F.lit(None).cast(lines.schema["line_idx"].dataType).alias("line_idx")
    said = utterance_lines(lines).join(files, "file_id")
    return reduce(
        DataFrame.union,
        [
            lines.where("kind = 'error'").select("file_id", "line_idx", *found(0, "unreadable line")),
            files.where(blank("participants")).select("file_id", none, *found(1, "no participants")),
            files.where(blank("languages")).select("file_id", none, *found(1, "no languages")),
            said.where(~F.col("ca") & F.col("terminator").isNull()).select("file_id", "line_idx", *found(1, "no terminator")),
            said.where(~F.array_contains(codes, F.col("speaker"))).select("file_id", "line_idx", *found(1, "undeclared speaker")),
            said.where(blank("text") & ~F.col("lazy_overlap") & F.col("lang").isNull()).select("file_id", "line_idx", *found(2, "empty main tier")),
        ],
    )


def passing(lines: DataFrame, found: DataFrame, level: int) -> DataFrame:
    """The lines of files without a violation up to a level."""
    return lines.join(found.where(F.col("level") <= level).select("file_id").distinct(), "file_id", "left_anti")


def media_of(files: DataFrame, media: DataFrame) -> DataFrame:
    """Rows (path, media): media with the stem of a transcript in its folder; of several the first by name."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    found = media.groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias("media"))
    return files.select("path", stem(F.col("path")).alias("stem")).join(found, "stem", "left").select("path", "media")


def output_path(path: Column, policy: str, value: str = "") -> Column:
    """Where a result goes: ``preserve``, ``extension`` or ``suffix`` (put before the extension)."""
    if policy == "preserve":
        return path
    if policy == "extension":
        return F.regexp_replace(path, r"\.[^./]+$", f".{value}")
    return F.regexp_replace(path, r"(\.[^./]+)$", f"{value}$1")


def feature_table(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows (f, frame) with a column for each feature of (f, frame, name, value), in order of name; of repeats the largest.

    The names are the caller's, or all that the table has: a feature set's, some thousands at most.
    """
    if names is None:
        names = [r.name for r in df.select("name").distinct().collect()]
    return df.groupBy("f", "frame").pivot("name", sorted(names)).agg(F.max("value"))


def functionals(df: DataFrame) -> DataFrame:
    """Rows (f, name, mean, deviation, low, high) over the frames of rows (f, frame, name, value)."""
    return df.groupBy("f", "name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), F.min("value").alias("low"), F.max("value").alias("high"))


def with_kept_tiers(after: DataFrame, before: DataFrame, matches: DataFrame) -> DataFrame:
    """C20: later utterances (f, after_idx, tiers) get the tiers of the earlier ones they match; their own win."""
    old = before.select("f", "before_idx", F.col("tiers").alias("old"))
    both = after.join(matches.select("f", "before_idx", "after_idx"), ["f", "after_idx"], "left").join(old, ["f", "before_idx"], "left")
    none = F.create_map().cast("map<string,string>")
    mine = F.coalesce("tiers", none)
    kept = F.map_filter(F.coalesce("old", none), lambda k, _: ~F.array_contains(F.map_keys(mine), k))
    return both.select("f", "after_idx", F.map_concat(kept, mine).alias("tiers"))


def injected(words: DataFrame, timings: DataFrame) -> DataFrame:
    """Words (f, g, u, p) take their group's timings (f, g, n, a, b) in order of utterance and word.

    There are as many timings as words, so neither side is ever sent to all executors, however small its estimate.
    """
    w = Window.partitionBy("f", "g").orderBy("u", "p")
    return words.withColumn("n", (F.row_number().over(w) - 1).cast("long")).join(timings.hint("merge"), ["f", "g", "n"], "left").select("f", "u", "p", "a", "b")


def reused_groups(groups: DataFrame, deltas: DataFrame) -> DataFrame:
    """Groups (f, g, after_idx) all of whose utterances are as before."""
    stable = deltas.withColumn("same", F.col("kind").isin("unchanged", "speaker_changed")).select("f", "after_idx", "same")
    return groups.join(stable, ["f", "after_idx"], "left").groupBy("f", "g").agg(F.bool_and(F.coalesce("same", F.lit(False))).alias("reused"))


def cached_tiers(lines: DataFrame, cached: DataFrame) -> DataFrame:
    """Lines (f, line_idx, tier) take cached tiers of the same line; others keep theirs."""
    return lines.join(cached.select("f", "line_idx", F.col("tier").alias("c")), ["f", "line_idx"], "left").select("f", "line_idx", F.coalesce("c", "tier").alias("tier"))


def in_position(df: DataFrame) -> DataFrame:
    """adds ``rank`` by fractional position, ties in the order they came (``seq``)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("f").orderBy("pos", "seq")))


def uncovered(ranges: Column, covered: Column) -> Column:
    """G1: what a range has beyond those before it."""
    return F.array_except(ranges, covered)


def without_subsets(ranges: Column) -> Column:
    """G1: arrays of places, longest first (later ones of a length first), each without what those before it hold; none left empty."""
    ordered = F.reverse(F.array_sort(F.transform(ranges, lambda r, k: F.struct(F.size(r).alias("n"), k.alias("k"), r.alias("r")))))
    none = F.array().cast("array<array<int>>")

    def step(acc: Column, x: Column) -> Column:
        own = F.array_sort(F.array_except(x["r"], F.flatten(acc)))
        return F.when(F.size(own) == 0, acc).otherwise(F.concat(acc, F.array(own)))

    return F.aggregate(ordered, none, step)


def provenance(tool: Column, version: Column, model: Column) -> Column:
    """The comment line that says what made a tier."""
    return F.format_string("@Comment:\t%s %s, %s", tool, version, model)


def stanza_word(df: DataFrame) -> DataFrame:
    """A tagged word whose lemma is empty or a bare mark takes its text; a missing relation becomes ``dep``."""
    bogus = F.coalesce(F.rlike(F.trim("lemma"), F.lit(r"^[^\p{L}\p{N}]*$")), F.lit(True)) & F.rlike("text", F.lit(r"[\p{L}\p{N}]"))
    relation = F.when(F.coalesce(F.trim("deprel"), F.lit("")).isin("", "<PAD>", "_"), "dep").otherwise(F.col("deprel"))
    return df.withColumns({"lemma": F.when(bogus, F.col("text")).otherwise(F.col("lemma")), "deprel": relation})

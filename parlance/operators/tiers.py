"""Operators on dependent tiers, languages and payloads of utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def without_tiers(tiers: Column, *names: str) -> Column:
    """A map of tiers without those named."""
    return F.map_filter(tiers, lambda k, _: ~k.isin(*names))


def with_tier(tiers: Column, name: str, value: Column) -> Column:
    """A map of tiers in which one is replaced or added; doing so twice changes nothing."""
    return F.map_concat(without_tiers(tiers, name), F.create_map(F.lit(name), value))


def utterance_language(lang: Column, declared: Column, primary: Column) -> Column:
    """The utterance's own language, else the first declared one, else the primary one."""
    return F.coalesce(lang, F.get(declared, 0), primary)


def monolingual(df: DataFrame, primary: str) -> DataFrame:
    """Utterances in the primary language or none of their own."""
    return df.where(F.col("lang").isNull() | (F.col("lang") == primary))


def supported(df: DataFrame, languages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose language is in the table, and the number skipped of each other language."""
    known = languages.select("lang").distinct()
    return df.join(known, "lang", "left_semi"), df.join(known, "lang", "left_anti").groupBy("lang").agg(F.count("*").alias("skipped"))


def payloads(df: DataFrame) -> DataFrame:
    """Adds ``for_translate`` (some text) and ``for_utseg`` (two words or more)."""
    n = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != ""))
    return df.withColumns({"for_translate": F.coalesce(n > 0, F.lit(False)), "for_utseg": F.coalesce(n > 1, F.lit(False))})


def coref_payloads(df: DataFrame) -> DataFrame:
    """Rows (f, sentences): the words of each file's utterances (f, line_idx, words) that have some, with their lines, in order."""
    some = df.where(F.size("words") > 0)
    return some.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("line_idx", "words"))).alias("sentences"))


def morphosyntax_payloads(df: DataFrame, primary: str, skip_other: bool = False) -> DataFrame:
    """Rows (f, line_idx, words, terminator, lang) of utterances (f, line_idx, words, terminator, lang, declared, tiers) to be tagged.

    Those that have a ``mor`` tier or no words are left out, and with ``skip_other`` those that say they are in another language.
    """
    tagged = F.coalesce(F.map_contains_key("tiers", F.lit("mor")), F.lit(False))
    rows = df.where(~tagged & (F.size("words") > 0))
    if skip_other:
        rows = monolingual(rows, primary)
    return rows.select("f", "line_idx", "words", F.coalesce("terminator", F.lit(".")).alias("terminator"), utterance_language(F.col("lang"), F.col("declared"), F.lit(primary)).alias("lang"))


def documents_with(df: DataFrame, language: str) -> DataFrame:
    """Files that declare a language."""
    return df.where(F.array_contains("languages", language))


def lost_annotations(df: DataFrame) -> DataFrame:
    """Rows (f, i, problem): no terminator, or not as many tags as words, or an end before the start."""
    checks = F.array_compact(
        F.array(
            F.when(F.col("terminator").isNull(), "terminator"), F.when(F.col("n_tags") != F.col("n_words"), "tags"), F.when(F.col("b") < F.col("a"), "timing")
        )
    )
    return df.select("f", "i", F.explode(checks).alias("problem"))


def metric_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, metric, value) from a row of metrics; ratios have four decimals."""
    pairs = ", ".join(f"'{c}', {'format_number' if t == 'double' else 'string'}({c}{', ' + chr(39) + '0.0000' + chr(39) if t == 'double' else ''})" for c, t in df.dtypes if c in columns)
    return df.selectExpr(key, f"stack({len(columns)}, {pairs}) as (metric, value)")


def voice_quality(df: DataFrame) -> DataFrame:
    """Adds ``avqi`` from acoustic measures."""
    score = 4.152 - 0.177 * F.col("cpps") - 0.006 * F.col("hnr") - 0.037 * F.col("shim") + 0.941 * F.col("shdb") + 0.01 * F.col("slope") + 0.093 * F.col("tilt")
    return df.withColumn("avqi", score * 2.8902)

"""Recognition results of providers as monologue elements and timed words.

Each reader takes rows (f, json) and returns rows (f, speaker, monologue, i, value, start_ms,
end_ms); words whose end is after their start are the timed ones.  Null or unreadable
JSON gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parlance.operators.words import cantonese_characters, cantonese_normal, provider_text

FUNAUDIO = "array<struct<text:string,timestamp:array<array<double>>>>"
TENCENT = "array<struct<StartMs:bigint,SpeakerId:int,Words:array<struct<Word:string,OffsetStartMs:bigint,OffsetEndMs:bigint>>>>"
ALIYUN = "array<struct<sentence_text:string,words:array<struct<text:string,startTime:bigint,endTime:bigint>>>>"


def _words(text: Column, lang: str) -> Column:
    if lang == "yue":
        return cantonese_characters(text)
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def _normal(word: Column, lang: str) -> Column:
    return cantonese_normal(word) if lang == "yue" else word


def _element(value: Column, start: Column, end: Column) -> Column:
    return F.struct(value.alias("value"), start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"))


def _elements(df: DataFrame, segments: Column, speaker, elements) -> DataFrame:
    """Rows of elements; monologues without any are left out and not counted."""
    made = F.transform(F.coalesce(segments, F.array()), lambda s: F.struct(speaker(s).alias("speaker"), elements(s).alias("elements")))
    rows = df.select("f", F.posexplode(F.filter(made, lambda m: F.size(m["elements"]) > 0)).alias("monologue", "m"))
    return rows.select("f", "monologue", "m.speaker", F.posexplode("m.elements").alias("i", "e")).select("f", "speaker", "monologue", "i", "e.*")


def funaudio_elements(df: DataFrame, lang: str = "eng") -> DataFrame:
    """Segments of text with a (start, end) for each of their tokens; one speaker.  A single segment may stand without a list."""
    text = F.trim("json")
    listed = F.when(F.startswith(text, F.lit("{")), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)

    def elements(s: Column) -> Column:
        at = lambda k, j: F.round(F.get(F.get(s["timestamp"], k), j))
        both = lambda k, j: F.when(at(k, 0).isNotNull() & at(k, 1).isNotNull(), at(k, j))
        return F.transform(_words(provider_text(F.coalesce(s["text"], F.lit(""))), lang), lambda w, k: _element(w, both(k, 0), both(k, 1)))

    return _elements(df, F.from_json(listed, FUNAUDIO), lambda _: F.lit(0), elements)


def tencent_elements(df: DataFrame, lang: str = "eng") -> DataFrame:
    """Segments with a start and words with offsets from it; a missing end is the start."""

    def elements(s: Column) -> Column:
        words = F.filter(F.coalesce(s["Words"], F.array()), lambda w: F.trim(F.coalesce(w["Word"], F.lit(""))) != "")
        start = lambda w: F.coalesce(w["OffsetStartMs"], F.lit(0))
        begin = F.coalesce(s["StartMs"], F.lit(0))
        return F.transform(words, lambda w: _element(_normal(F.trim(w["Word"]), lang), begin + start(w), begin + F.coalesce(w["OffsetEndMs"], start(w))))

    return _elements(df, F.from_json("json", TENCENT), lambda s: F.coalesce(s["SpeakerId"], F.lit(0)), elements)


def aliyun_elements(df: DataFrame, lang: str = "eng") -> DataFrame:
    """Sentences with timed words, or else a text whose words have no times; one speaker."""

    def elements(s: Column) -> Column:
        words = F.filter(F.coalesce(s["words"], F.array()), lambda w: F.trim(F.coalesce(w["text"], F.lit(""))) != "")
        timed = F.transform(words, lambda w: _element(_normal(F.trim(w["text"]), lang), F.coalesce(w["startTime"], F.lit(0)), F.coalesce(w["endTime"], F.lit(0))))
        none = F.lit(None)
        bare = F.transform(_words(F.coalesce(s["sentence_text"], F.lit("")), lang), lambda w: _element(w, none, none))
        return F.when(F.size(F.coalesce(s["words"], F.array())) > 0, timed).otherwise(bare)

    return _elements(df, F.from_json("json", ALIYUN), lambda _: F.lit(0), elements)


def timed_words(elements: DataFrame) -> DataFrame:
    """Rows (f, word, start_ms, end_ms) of the elements whose end is after their start, in order of start."""
    timed = elements.where("end_ms > start_ms")
    return timed.orderBy("f", "start_ms", "monologue", "i").select("f", F.col("value").alias("word"), "start_ms", "end_ms")

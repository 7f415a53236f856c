"""One function for each command: what a user calls, over DataFrames.

Models stay the caller's (``parlance.functions.models.register``); everything before and
after them runs here.  Transcripts are rows (file_id, text); utterances are rows
(f, u, speaker, words, ...) as each function says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from parlance.functions import models
from parlance.operators import morphology, recovery, sequence, tiers, timing, words
from parlance.sources import chat, content


def parsed(files: DataFrame) -> DataFrame:
    """Utterances (f, u, line_idx, speaker, lang, text, words, terminator, start_ms, end_ms, lazy_overlap) of transcripts.

    ``words`` are those that morphology takes: replacements for what they replace, no retraces, separators with tags.
    """
    u = chat.utterance_lines(chat.parse_lines(files)).withColumnsRenamed({"file_id": "f", "utt_idx": "u"})
    return u.withColumn("words", content.domain_words(content.tree(F.col("text")), "mor"))


def morphotag(utterances: DataFrame, primary: str = "eng", skip_other: bool = False) -> DataFrame:
    """Rows (f, line_idx, mor, gra, problem): tagged by the ``morphosyntax`` model, mapped to tiers, or what is wrong with the sentence."""
    sent = tiers.morphosyntax_payloads(utterances, primary, skip_other)
    function, _ = models._REGISTRY["morphosyntax"]
    schema = f"f {dict(sent.dtypes)['f']}, line_idx {dict(sent.dtypes)['line_idx']}, terminator string, lang string, {models.PAYLOADS['morphosyntax'][1]}"
    tagged = sent.mapInPandas(models.few_rows(function), schema)
    # An outer explode of one element binds what is used several times.
    t = tagged.select("f", "line_idx", "terminator", F.explode_outer(F.array(morphology.tagged_sentence(F.col("sentence"), F.col("lang")))).alias("t"))
    return t.select("f", "line_idx", F.concat(F.array_join("t.mor", " "), F.lit(" "), "terminator").alias("mor"), F.array_join("t.gra", " ").alias("gra"), "t.problem")


def utseg(utterances: DataFrame) -> DataFrame:
    """Rows (f, u, part, words): utterances (f, u, words, trees) cut by their bracketed trees; a cut part ends with a period of its own."""
    n = F.size("words")
    groups = utterances.select("f", "u", "words", sequence.utterance_groups_of(F.col("trees"), n).alias("g"))
    rows = groups.select("f", "u", F.posexplode(F.arrays_zip("words", "g")).alias("p", "x")).select("f", "u", "p", F.col("x.words").alias("word"), F.col("x.g").alias("g"))
    parts = words.by_assignment(rows).groupBy("f", "u", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]).alias("words"))
    several = F.max("part").over(Window.partitionBy("f", "u")) > 0
    return parts.select("f", "u", "part", F.when(several, F.concat("words", F.array(F.lit(".")))).otherwise(F.col("words")).alias("words"))


def translate(utterances: DataFrame, cache: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Rows (text, translation) of utterances with text, and the new entries for the cache (text, translation)."""
    ready = tiers.payloads(utterances).where("for_translate").select(words.translation_input(F.col("text"), F.lit(source)).alias("text")).distinct().withColumn("lang", F.lit(source))
    out, new = models.cached_map(ready, cache, "text", "translate")
    return out.withColumn("translation", words.translation_output(F.col("translation"))), new


def coref(utterances: DataFrame, language: str = "eng") -> DataFrame:
    """Rows (f, annotations): files that declare the language, sentence by sentence through the ``coref`` model; marks as ``words.chain_marks`` writes them."""
    payload = tiers.coref_payloads(tiers.documents_with(utterances, language))
    found = models.infer(payload, "coref")
    return found.select("f", F.explode("annotations").alias("a")).select("f", F.col("a.sentence_idx").alias("sentence_idx"), words.chain_marks(F.col("a.words")).alias("xcoref"))


def align(files: DataFrame, stitched: DataFrame, strategy: str = "auto", total_ms: int | None = None, most_ms: int = 20_000, config: recovery.TwoPass = recovery.TwoPass()) -> dict[str, DataFrame]:  # noqa: B008
    """Bullets of untimed utterances (``bullets``), the groups to be aligned (``groups``), and final word times (``words``).

    ``files`` has rows as ``recovery`` takes them; ``stitched`` the times that a model gave to words (f, u, i, a, b).  Words last to the
    next one's start, stay within their utterance, and utterances whose start goes back lose their times.
    """
    bullets = recovery.recover(files, strategy, config, total_ms, most_ms)
    counted = bullets.join(files.select("f", F.explode("utterances").alias("x")).select("f", F.col("x.u").alias("u"), F.size("x.words").cast("long").alias("w")), ["f", "u"])
    rows = counted.select("f", F.col("u").cast("long").alias("i"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), "w")
    groups = timing.group_by_duration(rows, most_ms, total_ms)
    within = stitched.join(bullets.select("f", "u", F.col("start_ms").alias("ua"), F.col("end_ms").alias("ub")), ["f", "u"], "left")
    timed = timing.clamp_to_utterance(timing.continuous_ends(within))
    ordered = timing.monotonic(rows).select("f", F.col("i").cast("int").alias("u"), "stripped")
    final = timed.join(ordered, ["f", "u"], "left").select("f", "u", "i", F.when(~F.col("stripped"), F.col("start2")).alias("start_ms"), F.when(~F.col("stripped"), F.col("end2")).alias("end_ms"))
    return {"bullets": bullets, "groups": groups, "words": final}


def transcribe(elements: DataFrame, lang: str = "eng") -> DataFrame:
    """Rows (f, utt, tok, word) from recognised elements (f, i, value, ts, end_ts): marks out, words split, turns cut, utterances ended."""
    from parlance.operators import records

    timed = records.timed_elements(elements).select("f", "i", F.col("value").alias("word"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    pieces = words.proportional_split(timed, lang)
    w = Window.partitionBy("f").orderBy("i", "j")
    flat = pieces.select("f", (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("piece").alias("word"), "a", "b").withColumn("chunk", F.floor(F.col("i") / words.LONG_TURN).cast("long"))
    parts = words.long_pauses(flat)
    # Each part is a file of its own, as an utterance never goes on in the next.
    keyed = parts.withColumn("part_key", F.dense_rank().over(Window.partitionBy("f").orderBy("chunk", "part")))
    rows = keyed.select(F.struct("f", "part_key").alias("f"), F.col("i").alias("p"), "word")
    said = words.into_utterances(rows)
    utt = F.dense_rank().over(Window.partitionBy("f.f").orderBy("f.part_key", "utt")) - 1
    out = said.select(F.col("f.f").alias("f"), utt.cast("long").alias("utt"), "tok", "word")
    return out.withColumn("word", words.disfluency(F.col("word"))) if lang == "eng" else out


def compare(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens (C5) and metrics (D1) of files (f, main, gold)."""
    tokens = sequence.compared(files)
    return tokens, sequence.compare_metrics(tokens)


def benchmark(pairs: DataFrame) -> DataFrame:
    """Rows (f, wer, errors, total, matches, diff) of pairs (f, hypothesis, reference), arrays of words."""
    return pairs.select("f", sequence.word_error_rate(F.col("hypothesis"), F.col("reference")).alias("e")).select("f", "e.*")


def opensmile(audio: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A table of features by file and frame from the ``opensmile`` model over rows (audio)."""
    from parlance.operators import records

    found = models.infer(audio, "opensmile")
    rows = found.select(F.col("audio").alias("f"), F.explode("features").alias("x")).select("f", "x.*")
    return records.feature_table(rows, names)


def avqi(audio: DataFrame) -> DataFrame:
    """Rows (audio, metric, value): voice quality and what it is made of, from the ``avqi`` model over rows (audio)."""
    found = tiers.voice_quality(models.infer(audio, "avqi"))
    return tiers.metric_rows(found, "audio", ["avqi", "cpps", "hnr", "shim", "shdb", "slope", "tilt"])

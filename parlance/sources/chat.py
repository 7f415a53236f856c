"""CHAT transcripts: scan, parse, and serialize.

Lines are ``@Header:<TAB>value``, ``*SPK:<TAB>content`` and ``%tier:<TAB>value``; a line that
begins with a tab continues the one before.  A bullet is ``start_end`` between U+0015.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

NAK = "\x15"
#: Participant codes by speaker index.
CODES = ("PAR", "INV", "CHI", "MOT", "FAT", "SIS", "BRO", "GRM")
_TERMINATORS = r'(\+\.\.\.|\+//\.|\+/\.|\+//\?|\+/\?|\+!\?|\+"/\.|\+"\.|\+\.\.\?|\+\.|[.?!])'


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file_id, text) of all ``.cha`` files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.cha").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))


def parse_lines(files: DataFrame) -> DataFrame:
    """A1: rows (file_id, line_idx, kind, key, value); a line of no kind is kept as ``error``."""
    lines = F.filter(F.split(F.regexp_replace("text", r"\r?\n\t", " "), r"\r?\n"), lambda x: x != "")
    rows = files.select("file_id", F.posexplode(lines).alias("line_idx", "line"))
    mark = F.substring("line", 1, 1)
    kind = F.when(mark == "@", "header").when((mark == "*") & F.contains("line", F.lit(":\t")), "utterance").when((mark == "%") & F.contains("line", F.lit(":\t")), "tier").otherwise("error")
    key = F.when(kind == "error", F.lit(None)).otherwise(F.substring_index(F.expr("substring(line, 2)"), ":\t", 1))
    value = F.when(F.contains("line", F.lit(":\t")), F.expr("substring(line, instr(line, ':\t') + 2)")).otherwise(F.when(kind == "error", F.col("line")).otherwise(""))
    return rows.select("file_id", "line_idx", kind.alias("kind"), key.alias("key"), value.alias("value"))


def strict_lines(files: DataFrame) -> DataFrame:
    """A2: as ``parse_lines``; a line of no kind fails the query."""
    rows = parse_lines(files)
    bad = F.raise_error(F.concat(F.lit("not a transcript line: "), "value"))
    return rows.withColumn("value", F.when(F.col("kind") == "error", bad.cast("string")).otherwise(F.col("value")))


def utterances(lines: DataFrame) -> DataFrame:
    """Rows (file_id, utt_idx, speaker, lang, text, terminator, start_ms, end_ms, lazy_overlap)."""
    return utterance_lines(lines).drop("line_idx")


def utterance_lines(lines: DataFrame) -> DataFrame:
    """As ``utterances``, with ``line_idx``: rows (file_id, utt_idx, line_idx, speaker, lang, text, terminator, start_ms, end_ms, lazy_overlap)."""
    w = Window.partitionBy("file_id").orderBy("line_idx")
    u = lines.where("kind = 'utterance'").withColumn("utt_idx", (F.row_number().over(w) - 1).cast("long"))
    bullet = lambda k: F.regexp_extract("value", f"{NAK}([0-9]+)_([0-9]+){NAK}", k).try_cast("long")
    body = F.trim(F.regexp_replace("value", f"{NAK}[^{NAK}]*{NAK}", ""))
    lang = F.nullif(F.regexp_extract(body, r"^\[- ([a-z]+)\]", 1), F.lit(""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"^\[- [a-z]+\]\s*", ""), r"^\+<\s*", ""))
    end = F.nullif(F.regexp_extract(plain, _TERMINATORS + "$", 1), F.lit(""))
    return u.select(
        "file_id", "utt_idx", "line_idx", F.col("key").alias("speaker"), lang.alias("lang"), F.trim(F.regexp_replace(plain, _TERMINATORS + "$", "")).alias("text"),
        end.alias("terminator"), bullet(1).alias("start_ms"), bullet(2).alias("end_ms"), F.rlike(body, F.lit(r"^(\[- [a-z]+\]\s*)?\+<")).alias("lazy_overlap"),
    )


def main_tier(text: Column) -> Column:
    """A1: the items (text, kind) of a main tier: ``word``, ``annotated`` (a word with a note behind it), ``mark`` (a separator with a tag), ``other``.

    Groups in angle brackets are opened: their words count as words.  Notes in square brackets, events,
    pauses, linkers and terminators are ``other``.
    """
    marks, note = ("‡", "„", ","), r"^\["
    tokens = F.filter(F.regexp_extract_all(text, F.lit(r"(\[[^\]]*\]|\+<|[^\s<>\[\]]+|[<>])"), 1), lambda x: ~x.isin("<", ">"))

    def item(x: Column, k: Column) -> Column:
        noted = F.rlike(F.coalesce(F.get(tokens, k + 1), F.lit("")), F.lit(note))
        kind = (
            F.when(x.isin(*marks), "mark").when(F.rlike(x, F.lit(rf"{note}|^\(\.+\)$|^&|^0|^(xxx|yyy|www)$|^{_TERMINATORS}$|^\+[<^,+\"]|^[⌈⌉⌊⌋↓↑]+$|{NAK}")), "other")
            .when(noted, "annotated").otherwise("word")
        )
        return F.struct(x.alias("text"), kind.alias("kind"))

    return F.transform(tokens, item)


def alignable(text: Column, domain: str = "mor") -> Column:
    """B1: the words of a main tier that a tier of a domain has items for: ``mor`` (with separators), ``wor`` (with fillers ``&-`` too), ``pho``, ``sin``."""
    items = main_tier(text)
    word = lambda x: x["kind"].isin("word", "annotated")
    if domain == "mor":
        kept = F.filter(items, lambda x: word(x) | (x["kind"] == "mark"))
    elif domain == "wor":
        kept = F.filter(items, lambda x: word(x) | F.startswith(x["text"], F.lit("&-")))
    else:
        kept = F.filter(items, word)
    return F.transform(kept, lambda x: x["text"])


def options(lines: DataFrame) -> DataFrame:
    """A3: rows (file_id, dummy, no_align) from ``@Options`` headers."""
    has = lambda name: F.coalesce(F.bool_or((F.col("kind") == "header") & (F.col("key") == "Options") & F.array_contains(F.split("value", r",\s*"), name)), F.lit(False))
    return lines.groupBy("file_id").agg(has("dummy").alias("dummy"), has("NoAlign").alias("no_align"))


def undeclared_speakers(lines: DataFrame) -> DataFrame:
    """Rows (file_id, speaker) of speakers that ``@Participants`` does not name."""
    declared = lines.where("kind = 'header' and key = 'Participants'").select("file_id", F.explode(F.split("value", r"\s*,\s*")).alias("p"))
    declared = declared.select("file_id", F.substring_index(F.trim("p"), " ", 1).alias("speaker"))
    spoken = lines.where("kind = 'utterance'").select("file_id", F.col("key").alias("speaker")).distinct()
    return spoken.join(declared, ["file_id", "speaker"], "left_anti")


def participant_code(index: Column) -> Column:
    """The code of a speaker index, ``SP<n>`` past the known ones."""
    codes = F.array(*map(F.lit, CODES))
    return F.when((index >= 0) & (index < len(CODES)), F.get(codes, index.cast("int"))).otherwise(F.concat(F.lit("SP"), index.cast("string")))


def serialize(lines: DataFrame) -> DataFrame:
    """A4: rows (file_id, text) from rows (file_id, line_idx, line); a file's lines are gathered in one row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda x: x["line"])
    return lines.groupBy("file_id").agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("text"))


def build(utts: DataFrame, language: str = "eng", media: str | None = None, kind: str = "audio", corpus: str = "corpus_name") -> DataFrame:
    """Transcripts from rows (file_id, utt_idx, speaker index, text, start_ms, end_ms), and ``lang`` if some differ."""
    code = participant_code(F.col("speaker"))
    own = F.when(F.col("lang") != language, F.concat(F.lit("[- "), "lang", F.lit("] "))).otherwise("") if "lang" in utts.columns else F.lit("")
    bullet = F.when(F.col("start_ms").isNotNull(), F.concat(F.lit(f" {NAK}"), "start_ms", F.lit("_"), "end_ms", F.lit(NAK))).otherwise("")
    end = F.when(F.rlike(F.col("text"), F.lit(_TERMINATORS + "$")), "").otherwise(" .")
    body = utts.select("file_id", (F.col("utt_idx") + (1 << 20)).alias("line_idx"), F.concat(F.lit("*"), code, F.lit(":\t"), own, "text", end, bullet).alias("line"))
    who = utts.select("file_id", "speaker", code.alias("code")).distinct().groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("speaker", "code"))).alias("who"))
    return serialize(_framed(who, F.transform("who", lambda x: F.struct(x["code"].alias("id"), F.lit("Participant").alias("role"), F.lit(corpus).alias("corpus"))), F.lit(language), F.lit(media), F.lit(kind)).unionByName(body))


def _framed(files: DataFrame, people: Column, languages: Column, media: Column, kind: Column) -> DataFrame:
    """Header and end lines of files from participants (id, role, corpus)."""
    named = F.array_join(F.transform(people, lambda p: F.concat(p["id"], F.lit(" Participant"), F.when(p["role"] == "Participant", "").otherwise(F.concat(F.lit(" "), p["role"])))), ", ")
    first = F.substring_index(languages, ",", 1)
    ids = F.transform(people, lambda p: F.concat(F.lit("@ID:\t"), first, F.lit("|"), p["corpus"], F.lit("|"), p["id"], F.lit("|||||"), p["role"], F.lit("|||")))
    stem = F.regexp_replace(F.regexp_extract(media, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    head = F.concat(
        F.array(F.lit("@UTF8"), F.lit("@Begin"), F.concat(F.lit("@Languages:\t"), languages), F.concat(F.lit("@Participants:\t"), named)), ids,
        F.when(media.isNotNull(), F.array(F.concat(F.lit("@Media:\t"), stem, F.lit(", "), F.coalesce(kind, F.lit("audio"))))).otherwise(F.array().cast("array<string>")),
    )
    top = files.select("file_id", F.posexplode(head).alias("line_idx", "line")).withColumn("line_idx", F.col("line_idx").cast("long"))
    return top.unionByName(files.select("file_id", F.lit(1 << 60).alias("line_idx"), F.lit("@End").alias("line")))


#: A transcript as JSON.
DESCRIPTION = (
    "struct<langs:array<string>,participants:array<struct<id:string,name:string,role:string,corpus:string>>,media_name:string,media_type:string,"
    "utterances:array<struct<speaker:string,text:string,words:array<struct<text:string,start_ms:bigint,end_ms:bigint>>,start_ms:bigint,end_ms:bigint,lang:string>>>"
)


def build_from_json(df: DataFrame) -> DataFrame:
    """A5: transcripts from rows (file_id, json); a file without participants is an error.

    An utterance of words is timed by its first start and last end; one without words or text is left out.
    """
    d = df.select("file_id", F.from_json("json", DESCRIPTION).alias("d"))
    ok = F.assert_true(F.size(F.coalesce("d.participants", F.array())) > 0, "at least one participant is required")
    langs = F.when(F.size(F.coalesce("d.langs", F.array())) > 0, F.array_join("d.langs", ", ")).otherwise("eng")
    d = d.withColumn("langs", F.when(ok.isNull(), langs))
    part = F.lit("Participant")
    people = F.transform("d.participants", lambda p: F.struct(p["id"].alias("id"), F.coalesce(p["role"], part).alias("role"), F.coalesce(p["corpus"], F.lit("corpus_name")).alias("corpus")))
    u = d.select("file_id", "langs", F.posexplode("d.utterances").alias("k", "u"))
    words = F.coalesce("u.words", F.array())
    body = F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: w["text"]), " ")).otherwise(F.col("u.text"))
    starts, ends = F.filter(F.transform(words, lambda w: w["start_ms"]), lambda x: x.isNotNull()), F.filter(F.transform(words, lambda w: w["end_ms"]), lambda x: x.isNotNull())
    start, end = F.coalesce(F.get(starts, 0), "u.start_ms"), F.coalesce(F.get(ends, F.size(ends) - 1), "u.end_ms")
    bullet = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit(f" {NAK}"), start, F.lit("_"), end, F.lit(NAK))).otherwise("")
    own = F.when(F.col("u.lang") != F.substring_index("langs", ",", 1), F.concat(F.lit("[- "), "u.lang", F.lit("] "))).otherwise("")
    stop = F.when(F.rlike(body, F.lit(_TERMINATORS + "$")), "").otherwise(" .")
    lines = u.where(F.coalesce(body, F.lit("")) != "").select("file_id", (F.col("k") + (1 << 20)).cast("long").alias("line_idx"), F.concat(F.lit("*"), "u.speaker", F.lit(":\t"), own, body, stop, bullet).alias("line"))
    return serialize(_framed(d, people, F.col("langs"), F.col("d.media_name"), F.col("d.media_type")).unionByName(lines))

"""Queries of transcripts, comparison, timing recovery, morphology, providers, stores and streams, with their SQL.

Inputs are derived from the driver's tables as in ``catalog``.  Where a query's input is made
up so that its result is known, the SQL states that result from the rule, not from the
operator's steps.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parlance import commands
from parlance.functions import models
from parlance.operators import align, morphology, records, recovery, sequence, store, tiers, timing, words
from parlance.plans.catalog import _CHAT, _duck, _pairs, _read, _scalar, _transcripts, _words, D_TURN, D_WORDS, query, TABLES, TURN
from parlance.sources import chat, files, providers
from parlance.streaming import feed

# --- transcripts -------------------------------------------------------------------------

#: What is odd about some transcripts, by their number: options, lines put in before the end, headers left out.
_OPTIONS = {"dummy": "conv_id % 5 = 0", "NoAlign": "conv_id % 7 = 0", "CA": "conv_id % 3 = 0"}
_EXTRA = {"*XXX:\thello .": "conv_id % 4 = 0", "*PAR:\tno end here": "conv_id % 8 = 1", "*PAR:\t.": "conv_id % 8 = 2", "broken line": "conv_id % 9 = 5"}
_NO_PEOPLE, _NO_LANGUAGES = "conv_id % 10 = 7", "conv_id % 12 = 8"


def _odd(s: SparkSession, d: str) -> DataFrame:
    t = _transcripts(s, d).withColumnRenamed("file_id", "conv_id")
    names = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in _OPTIONS.items()]))
    options = F.when(F.size(names) > 0, F.concat(F.lit("@Begin\n@Options:\t"), F.array_join(names, ", "), F.lit("\n"))).otherwise("@Begin\n")
    lines = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(line + "\n")) for line, test in _EXTRA.items()]))
    text = F.replace(F.replace("text", F.lit("@Begin\n"), options), F.lit("@End\n"), F.concat(F.array_join(lines, ""), F.lit("@End\n")))
    text = F.when(F.expr(_NO_PEOPLE), F.regexp_replace(text, "@Participants:[^\n]*\n", "")).otherwise(text)
    text = F.when(F.expr(_NO_LANGUAGES), F.regexp_replace(text, "@Languages:[^\n]*\n", "")).otherwise(text)
    return t.select(F.col("conv_id").alias("file_id"), text.alias("text"))


def _odd_lines(s: SparkSession, d: str) -> DataFrame:
    return chat.parse_lines(_odd(s, d))


_D_CHAT = """SELECT conv_id AS f, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 9 END AS sp, CASE role WHEN 'user' THEN 'PAR' WHEN 'assistant' THEN 'INV' ELSE 'SP9' END AS code,
  coalesce(trim(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g')), '') AS t FROM conversations"""
#: The whole text of each transcript.
_D_TEXT = f"""WITH c AS ({_D_CHAT}), w AS (SELECT f, string_agg(code || ' Participant', ', ' ORDER BY sp) AS people, string_agg('@ID:' || chr(9) || 'eng|corpus_name|' || code || '|||||Participant|||', chr(10) ORDER BY sp) AS ids
  FROM (SELECT DISTINCT f, sp, code FROM c) x GROUP BY f), u AS (SELECT f, string_agg('*' || code || ':' || chr(9) || t || ' . ' || chr(21) || turn * 1000 || '_' || (turn * 1000 + 900) || chr(21), chr(10) ORDER BY turn) AS said FROM c GROUP BY f)
  SELECT f AS file_id, '@UTF8' || chr(10) || '@Begin' || chr(10) || '@Languages:' || chr(9) || 'eng' || chr(10) || '@Participants:' || chr(9) || people || chr(10) || ids || chr(10) || said || chr(10) || '@End' || chr(10) AS text
  FROM w JOIN u USING (f)"""

query("a5_build_chat", _D_TEXT)(lambda s, d: _transcripts(s, d))
query("a4_serialize", _D_TEXT)(lambda s, d: chat.serialize(_lines_of(_transcripts(s, d))))


def _lines_of(texts: DataFrame) -> DataFrame:
    """Parsed lines written as lines again."""
    p = chat.parse_lines(texts)
    mark = F.when(F.col("kind") == "header", "@").when(F.col("kind") == "utterance", "*").otherwise("%")
    line = F.concat(mark, F.col("key"), F.when(F.col("value") != "", F.concat(F.lit(":\t"), F.col("value"))).otherwise(""))
    return p.select("file_id", "line_idx", line.alias("line"))


@query("a5_build_from_json", _D_TEXT)
def _from_json(s: SparkSession, d: str) -> DataFrame:
    rows = _read(s, d, _CHAT).withColumn("code", chat.participant_code(F.col("speaker")))
    said = F.array_sort(F.collect_list(F.struct("utt_idx", F.col("code").alias("speaker"), "text", "start_ms", "end_ms")))
    who = F.array_sort(F.collect_set(F.struct("speaker", F.col("code").alias("id"))))
    t = rows.groupBy("file_id").agg(who.alias("participants"), said.alias("utterances"))
    # An utterance without text is left out by the builder, so one blank stands for it.
    said = F.transform("utterances", lambda u: F.struct(u["speaker"].alias("speaker"), F.concat(u["text"], F.lit(" .")).alias("text"), u["start_ms"].alias("start_ms"), u["end_ms"].alias("end_ms")))
    return chat.build_from_json(t.select("file_id", F.to_json(F.struct(F.array(F.lit("eng")).alias("langs"), F.transform("participants", lambda p: F.struct(p["id"].alias("id"))).alias("participants"), said.alias("utterances"))).alias("json")))


query("a2_strict_lines", "SELECT f AS file_id, count(*) + max(n) + 5 AS n FROM (SELECT conv_id AS f, count(DISTINCT role) OVER (PARTITION BY conv_id) AS n FROM conversations) t GROUP BY f")(
    lambda s, d: chat.strict_lines(_transcripts(s, d)).where("value is not null or value is null").groupBy("file_id").agg(F.count("value").alias("n"))
)
query("a3_options", f"SELECT DISTINCT conv_id AS file_id, {_OPTIONS['dummy']} AS dummy, {_OPTIONS['NoAlign']} AS no_align FROM conversations")(lambda s, d: chat.options(_odd_lines(s, d)))
query(
    "b5_undeclared_speakers",
    f"""SELECT DISTINCT conv_id AS file_id, 'XXX' AS speaker FROM conversations WHERE conv_id % 4 = 0 UNION SELECT conv_id, CASE role WHEN 'user' THEN 'PAR' WHEN 'assistant' THEN 'INV' ELSE 'SP9' END FROM conversations WHERE {_NO_PEOPLE}
    UNION SELECT conv_id, 'PAR' FROM conversations GROUP BY conv_id HAVING conv_id % 8 IN (1, 2) AND ({_NO_PEOPLE} OR NOT bool_or(role = 'user'))""",
)(lambda s, d: chat.undeclared_speakers(_odd_lines(s, d)))
_B4 = f"""WITH c AS (SELECT conv_id, count(*) AS n, bool_or(role = 'user') AS par FROM conversations GROUP BY conv_id),
  v AS (SELECT conv_id, 0 AS level, 'unreadable line' AS problem, 1 AS n FROM c WHERE conv_id % 9 = 5 UNION ALL SELECT conv_id, 1, 'no participants', 1 FROM c WHERE {_NO_PEOPLE}
  UNION ALL SELECT conv_id, 1, 'no languages', 1 FROM c WHERE {_NO_LANGUAGES} UNION ALL SELECT conv_id, 1, 'no terminator', 1 FROM c WHERE conv_id % 8 = 1 AND conv_id % 3 <> 0
  UNION ALL SELECT conv_id, 1, 'undeclared speaker', CASE WHEN {_NO_PEOPLE} THEN n ELSE 0 END + CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN conv_id % 8 IN (1, 2) AND ({_NO_PEOPLE} OR NOT par) THEN 1 ELSE 0 END FROM c
  UNION ALL SELECT conv_id, 2, 'empty main tier', 1 FROM c WHERE conv_id % 8 = 2
  UNION ALL SELECT conv_id, 2, 'empty main tier', 1 FROM ({_D_CHAT.replace("conv_id AS f", "conv_id")}) e WHERE t = '')"""
query("b4_violations", _B4 + " SELECT conv_id AS file_id, level, problem, sum(n)::BIGINT AS n FROM v WHERE n > 0 GROUP BY ALL")(
    lambda s, d: records.violations(_odd_lines(s, d)).groupBy("file_id", "level", "problem").agg(F.count("*").alias("n"))
)
query("b4_passing", _B4 + " SELECT DISTINCT conv_id AS file_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM v WHERE n > 0 AND level <= 1)")(
    lambda s, d: records.passing((lines := _odd_lines(s, d)), records.violations(lines), 1).select("file_id").distinct()
)
#: Main tiers with every kind of item, and the words that each domain has items for.
_TIERS = (
    ("hello &-um the dog [*] , xxx ran .", "hello the dog , ran", "hello &-um the dog ran"), ("<I want> [/] I want (.) &~gaga cookie ?", "I want I want cookie", "I want I want cookie"),
    ("+< yes ‡ no +...", "yes ‡ no", "yes no"), ("0is it &=laughs &+fr friend's (be)cause !", "it friend's (be)cause", "it friend's (be)cause"),
)
_case = lambda n, values: "CASE " + " ".join(f"WHEN event_id % {n} = {k} THEN '" + v.replace("'", "''") + "'" for k, v in enumerate(values)) + " END"
_scalar(
    "b1_alignable_words", f"SELECT event_id AS k, {_case(4, [t for t, *_ in _TIERS])} AS t FROM {{events}}".replace("''", "\\'"), lambda: {"mor": F.array_join(chat.alignable(F.col("t")), " "), "wor": F.array_join(chat.alignable(F.col("t"), "wor"), " ")},
    f"SELECT event_id AS k, {_case(4, [m for _, m, _ in _TIERS])} AS mor, {_case(4, [w for *_, w in _TIERS])} AS wor FROM events",
)
_ELEMENTS = """SELECT user_id % 10 AS f, event_id AS i, CASE WHEN event_id % 5 = 0 THEN '<pause>' WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 11 = 0 THEN ' <inaudible> ' WHEN event_id % 13 = 0 THEN concat(' ', event_type, ' ')
  ELSE event_type END AS value, event_id * 0.5 AS ts, CASE WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE event_id * 0.5 + (event_id % 3) * 0.2503 END AS end_ts FROM {events}"""
query(
    "b3_timed_elements",
    """SELECT user_id % 10 AS f, event_id AS i, event_type AS value, CASE WHEN event_id % 3 > 0 AND event_id % 17 <> 0 THEN event_id * 500 END AS start_ms,
    CASE WHEN event_id % 3 > 0 AND event_id % 17 <> 0 THEN CAST(round((event_id * 0.5 + (event_id % 3) * 0.2503) * 1000) AS BIGINT) END AS end_ms FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0""",
)(lambda s, d: records.timed_elements(_read(s, d, _ELEMENTS).withColumns({c: F.col(c).cast("double") for c in ("ts", "end_ts")})))
query("b7_coref_payloads", f"SELECT f, list(u ORDER BY u)::VARCHAR AS lines, sum(len(ws))::BIGINT AS n FROM ({D_TURN}) t WHERE len(ws) > 0 GROUP BY f")(
    lambda s, d: tiers.coref_payloads(_turns(s, d).withColumnRenamed("u", "line_idx")).select("f", F.concat(F.lit("["), F.array_join(F.transform("sentences", lambda x: x["line_idx"].cast("string")), ", "), F.lit("]")).alias("lines"), F.aggregate("sentences", F.lit(0).cast("long"), lambda a, x: a + F.size(x["words"])).alias("n"))
)
query("b7_morphosyntax_payloads", f"SELECT f, u AS line_idx, CASE WHEN u % 4 = 1 THEN '?' ELSE '.' END AS terminator, CASE WHEN u % 5 = 2 THEN 'eng' ELSE 'fra' END AS lang FROM ({D_TURN}) t WHERE len(ws) > 0 AND u % 3 <> 0 AND u % 7 <> 4")(
    lambda s, d: tiers.morphosyntax_payloads(
        _turns(s, d).select(
            "f", F.col("u").alias("line_idx"), "words", F.when(F.col("u") % 4 == 1, "?").alias("terminator"), F.when(F.col("u") % 7 == 4, "spa").when(F.col("u") % 5 == 2, "eng").alias("lang"), F.array(F.lit("fra")).alias("declared"),
            F.when(F.col("u") % 3 == 0, F.create_map(F.lit("mor"), F.lit("x"))).otherwise(F.create_map(F.lit("gra"), F.lit("x"))).alias("tiers"),
        ), "eng", True,
    ).select("f", "line_idx", "terminator", "lang")
)
query("b14_documents_with", "SELECT doc_id FROM documents WHERE lang = 'en' OR doc_id % 5 = 0")(
    lambda s, d: tiers.documents_with(_read(s, d, "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN array('de', 'en') ELSE array(lang) END AS languages FROM {documents}"), "en").select("doc_id")
)


def _turns(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, TURN).select("f", "u", "role", F.when(F.trim("text") == "", F.array().cast("array<string>")).otherwise(F.split(F.trim("text"), r"\s+")).alias("words"))


# --- files -------------------------------------------------------------------------------

query("a7_discovered", " UNION ALL ".join(f"SELECT '{t}.parquet' AS name" for t in TABLES))(
    lambda s, d: files.discovered(s, d, ["parquet"]).where("size > 0").select(F.regexp_extract("path", r"(\w+\.parquet)(/[^/]*)?$", 1).alias("name")).distinct().join(s.createDataFrame([(f"{t}.parquet",) for t in TABLES], "name string"), "name")
)
_A8 = "SELECT p_partkey AS k, concat(CASE p_partkey % 4 WHEN 0 THEN '/in/a/x/' WHEN 1 THEN '/in/b/' WHEN 2 THEN '/home/me/one/' ELSE '/home/me/two/' END, p_partkey, '.cha') AS path FROM {part}"
query("a8_server_names", f"SELECT k, CASE k % 4 WHEN 0 THEN 'x/' WHEN 1 THEN '' WHEN 2 THEN 'one/' ELSE 'two/' END || k || '.cha' AS name FROM {_duck(_A8)} t")(lambda s, d: files.server_names(_read(s, d, _A8), ["/in/a", "/in/b/"]).select("k", "name"))


@query("a17_cache_table", "SELECT concat('k', l_partkey) AS key, concat('t', l_linenumber % 3) AS task, l_orderkey AS data FROM lineitem WHERE l_linenumber % 3 = 1")
def _cache_table(s: SparkSession, d: str) -> DataFrame:
    path = f"{feed.shared_folder(s)}/cache-{uuid.uuid4().hex}"
    files.save_cache(_read(s, d, "SELECT concat('k', l_partkey) AS key, concat('t', l_linenumber % 3) AS task, l_orderkey AS data FROM {lineitem}"), path)
    return files.load_cache(s, path, "t1").select("key", "task", "data")


query(
    "a14_report_rows",
    """SELECT l_orderkey AS f, m AS metric, printf('%.4f', CASE m WHEN 'avqi' THEN avqi ELSE cpps END) AS value FROM (SELECT l_orderkey, max((4.152 - 0.177 * l_quantity) * 2.8902) AS avqi, max(l_quantity) AS cpps FROM lineitem GROUP BY l_orderkey) t, unnest(['avqi', 'cpps']) AS r(m)""",
)(lambda s, d: tiers.metric_rows(_read(s, d, "SELECT l_orderkey AS f, max((4.152 - 0.177 * l_quantity) * 2.8902) AS avqi, max(l_quantity) AS cpps FROM {lineitem} GROUP BY l_orderkey"), "f", ["avqi", "cpps"]))
_GRID = "SELECT f, u % 2 AS speaker, u * 10000 + p AS i, word, (u * 1000 + p) * 500 AS a, (u * 1000 + p) * 500 + CASE WHEN p % 3 = 0 THEN 500 ELSE 300 END AS b FROM"
query(
    "a19_text_grids",
    f"""WITH w AS ({_GRID} ({D_WORDS}) q), t AS (SELECT *, max(b) OVER (PARTITION BY f) AS total, coalesce(lag(b) OVER (PARTITION BY f, speaker ORDER BY a), 0) AS fr, lead(a) OVER (PARTITION BY f, speaker ORDER BY a) IS NULL AS last FROM w),
    c AS (SELECT f, speaker, total, a, 0 AS o, fr AS x, a AS y, '' AS t FROM t WHERE a > fr UNION ALL SELECT f, speaker, total, a, 1, a, b, replace(word, '"', '""') FROM t UNION ALL SELECT f, speaker, total, a, 2, b, total, '' FROM t WHERE last AND b < total),
    n AS (SELECT *, row_number() OVER (PARTITION BY f, speaker ORDER BY a, o) AS k FROM c),
    g AS (SELECT f, speaker, max(total) AS total, count(*) AS n, string_agg(printf('        intervals [%d]:', k) || chr(10) || printf('            xmin = %.3f', x / 1000) || chr(10) || printf('            xmax = %.3f', y / 1000) || chr(10) || '            text = "' || t || '"' || chr(10), '' ORDER BY k) AS body FROM n GROUP BY f, speaker),
    h AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY speaker) AS nr FROM g)
    SELECT f, 'File type = "ooTextFile"' || chr(10) || 'Object class = "TextGrid"' || chr(10) || chr(10) || 'xmin = 0.000' || chr(10) || printf('xmax = %.3f', max(total) / 1000) || chr(10) || 'tiers? <exists>' || chr(10) || printf('size = %d', count(*)) || chr(10) || 'item []:' || chr(10)
    || string_agg(printf('    item [%d]:', nr) || chr(10) || '        class = "IntervalTier"' || chr(10) || '        name = "' || speaker || '"' || chr(10) || '        xmin = 0.000' || chr(10) || printf('        xmax = %.3f', total / 1000) || chr(10) || printf('        intervals: size = %d', n) || chr(10) || body, '' ORDER BY nr) AS text FROM h GROUP BY f""",
)(lambda s, d: files.text_grids(s.sql(_GRID + " {t}", t=_words(s, d))))

# --- providers ---------------------------------------------------------------------------

_TOKENS = f"SELECT f, u AS monologue, CAST(i AS INTEGER) AS i, ws[i + 1] AS value FROM ({D_TURN}) t, unnest(range(len(ws))) AS r(i)"


def _segments(s: SparkSession, d: str, one: Column) -> DataFrame:
    """A list of each conversation's turns, as JSON."""
    t = _turns(s, d).where(F.size("words") > 0).withColumn("one", one).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("u", "one"))).alias("t"))
    return t.select("f", F.to_json(F.transform("t", lambda x: x["one"])).alias("json"))


_NUMBERED = f"SELECT *, CAST(dense_rank() OVER (PARTITION BY f ORDER BY monologue) - 1 AS INTEGER) AS m FROM ({_TOKENS}) t"
query("a20_tencent", f"SELECT f, CAST(monologue % 3 AS INTEGER) AS speaker, m AS monologue, i, value, monologue * 10000 + i * 100 AS start_ms, monologue * 10000 + i * 100 + CASE WHEN i % 4 = 0 THEN 0 ELSE 80 END AS end_ms FROM ({_NUMBERED}) n")(
    lambda s, d: providers.tencent_elements(
        _segments(s, d, F.struct((F.col("u") * 10000).alias("StartMs"), (F.col("u") % 3).alias("SpeakerId"), F.transform("words", lambda w, k: F.struct(F.concat(F.lit(" "), w).alias("Word"), (k * 100).alias("OffsetStartMs"), F.when(k % 4 != 0, k * 100 + 80).alias("OffsetEndMs"))).alias("Words")))
    )
)
query("a20_aliyun", f"SELECT f, 0 AS speaker, m AS monologue, i, value, CASE WHEN monologue % 2 = 0 THEN i * 50 END AS start_ms, CASE WHEN monologue % 2 = 0 THEN i * 50 + 40 END AS end_ms FROM ({_NUMBERED}) n")(
    lambda s, d: providers.aliyun_elements(
        _segments(s, d, F.struct(F.array_join("words", " ").alias("sentence_text"), F.when(F.col("u") % 2 == 0, F.transform("words", lambda w, k: F.struct(w.alias("text"), (k * 50).alias("startTime"), (k * 50 + 40).alias("endTime")))).otherwise(F.array()).alias("words")))
    )
)
_PLAIN = "regexp_matches(value, '^[A-Za-z0-9]+$')"
query(
    "a20_funaudio",
    f"""WITH w AS (SELECT * FROM ({_TOKENS}) t WHERE {_PLAIN}), n AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY f ORDER BY monologue) - 1 AS INTEGER) AS m, CAST(row_number() OVER (PARTITION BY f, monologue ORDER BY i) - 1 AS INTEGER) AS k FROM w)
    SELECT f, 0 AS speaker, m AS monologue, k AS i, value, CASE WHEN k < 5 THEN k * 100 END AS start_ms, CASE WHEN k < 5 THEN k * 100 + 90 END AS end_ms FROM n""",
)(
    lambda s, d: providers.funaudio_elements(
        _segments(s, d, F.struct(F.concat(F.lit("<|zh|>「"), F.array_join(F.filter("words", lambda w: F.rlike(w, F.lit("^[A-Za-z0-9]+$"))), "，"), F.lit("」。")).alias("text"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.array(k * 100 + 0.4, k * 100 + 89.6)).alias("timestamp")))
    )
)
query("a20_timed_words", f"SELECT f, value AS word, monologue * 10000 + i * 100 AS start_ms, monologue * 10000 + i * 100 + 80 AS end_ms FROM ({_TOKENS}) t WHERE i % 4 <> 0")(
    lambda s, d: providers.timed_words(
        providers.tencent_elements(_segments(s, d, F.struct((F.col("u") * 10000).alias("StartMs"), F.transform("words", lambda w, k: F.struct(w.alias("Word"), (k * 100).alias("OffsetStartMs"), F.when(k % 4 != 0, k * 100 + 80).alias("OffsetEndMs"))).alias("Words"))))
    )
)
#: Provider texts and Cantonese texts with what they become.
_H33 = (("<|zh|> hello", "hello"), ("你好，世界！", "你好 世界"), ("「hello」", "hello"), ("<|zh|> 「你好」，我係啊！", "你好 我係啊"), ("a <|x", "a <|"), (" a  b ", "a b"))
_H5 = (("真系啊", "真係啊"), ("聯係系", "聯繫係"), ("你中意咩？", "你鍾意咩？"), ("呀噶咧", "啊㗎呢"), ("plain", "plain"), ("重復 分鍾。", "重複 分鐘。"))
_chars = lambda t: " ".join(c for c in t if c not in "、。，！？「」：； 　")
_scalar("h33_provider_text", f"SELECT event_id AS k, {_case(6, [a for a, _ in _H33])} AS t FROM {{events}}", lambda: {"t": words.provider_text(F.col("t"))}, f"SELECT event_id AS k, {_case(6, [b for _, b in _H33])} AS t FROM events")
_scalar("h5_cantonese", f"SELECT event_id AS k, {_case(6, [a for a, _ in _H5])} AS t FROM {{events}}", lambda: {"t": words.cantonese_normal(F.col("t")), "c": F.array_join(words.cantonese_characters(F.col("t")), " ")},
        f"SELECT event_id AS k, {_case(6, [b for _, b in _H5])} AS t, {_case(6, [_chars(b) for _, b in _H5])} AS c FROM events")
_scalar("h11_detected_language", "SELECT doc_id AS k, text, lang, (doc_id % 10) / 10.0 AS c FROM {documents}", lambda: {"lang": words.detected_language(F.col("text"), lambda t: F.struct(F.col("lang"), F.col("c").alias("confidence")))},
        "SELECT doc_id AS k, CASE WHEN doc_id % 10 >= 5 AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 40 THEN lang END AS lang FROM documents")
_scalar("h25_audio_identity", "SELECT page_id AS k, url, length(html) AS size FROM {pages}", lambda: {"i": sequence.audio_identity(F.col("url"), F.col("k"), F.col("size"))}, "SELECT page_id AS k, concat_ws('|', url, page_id, length(html)) AS i FROM pages")
_scalar("h31_failure_category", "SELECT event_id AS k, CASE event_id % 6 WHEN 0 THEN 'ready_timeout' WHEN 1 THEN 'process_exited' WHEN 2 THEN 'protocol' WHEN 3 THEN 'worker_response' WHEN 4 THEN 'validation' ELSE 'no_worker' END AS e, CASE WHEN user_id % 2 = 0 THEN 'a timeout' ELSE 'x' END AS m FROM {events}",
        lambda: {"c": words.failure_category(F.col("e"), F.col("m")), "again": words.retryable(words.failure_category(F.col("e"), F.col("m")))},
        "SELECT k, c, c IN ('worker_timeout', 'worker_crash', 'provider_transient') AS again FROM (SELECT event_id AS k, CASE event_id % 6 WHEN 0 THEN 'worker_timeout' WHEN 1 THEN 'worker_crash' WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'worker_timeout' ELSE 'worker_protocol' END WHEN 3 THEN 'provider_transient' WHEN 4 THEN 'validation' ELSE 'system' END AS c FROM events) t")

# --- morphology --------------------------------------------------------------------------

#: Words of turns, letters only, with a tag by length, features by place, and pairs in a range (places 4 and 5 of each six).
_TAGS = "CASE length(word) % 6 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'PRON' WHEN 3 THEN 'DET' WHEN 4 THEN 'ADJ' ELSE 'ADV' END"
_FEATS = "CASE p % 3 WHEN 1 THEN 'Number=Plur' WHEN 2 THEN 'Number=Sing|Person=3' END"
_LETTERS = f"SELECT f, u, CAST(row_number() OVER (PARTITION BY f, u ORDER BY p) - 1 AS INTEGER) AS p, lower(regexp_replace(word, '[^A-Za-z]', '', 'g')) AS word FROM ({D_WORDS}) t WHERE regexp_replace(word, '[^A-Za-z]', '', 'g') <> ''"


def _tagged(s: SparkSession, d: str) -> DataFrame:
    w = _words(s, d).select("f", "u", "p", F.lower(F.regexp_replace("word", "[^A-Za-z]", "")).alias("word")).where("word != ''")
    t = w.groupBy("f", "u").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x, k: F.struct(k.alias("p"), x["word"].alias("word"))).alias("ws"))
    n = F.size("ws")

    def rows(x: Column, k: Column) -> Column:
        tag = F.get(F.array(*map(F.lit, ("NOUN", "VERB", "PRON", "DET", "ADJ", "ADV"))), F.length(x["word"]) % 6)
        feats = F.when(k % 3 == 1, "Number=Plur").when(k % 3 == 2, "Number=Sing|Person=3")
        word = lambda i, e, head: F.struct(i.alias("id"), e.cast("int").alias("id_end"), F.lit(False).alias("decimal"), x["word"].alias("text"), x["word"].alias("lemma"), tag.alias("upos"), feats.alias("feats"), head.alias("head"), F.when(k == 0, "root").otherwise("nmod:poss").alias("deprel"))
        own = word(k + 1, F.lit(None), F.when(k == 0, 0).otherwise(1))
        return F.when((k % 6 == 4) & (k + 1 < n), F.array(word(k + 1, k + 2, F.lit(0)), own)).otherwise(F.array(own))

    return t.select("f", "u", F.flatten(F.transform("ws", rows)).alias("sentence"))


_MOR = f"""WITH l AS ({_LETTERS}), w AS (SELECT *, count(*) OVER (PARTITION BY f, u) AS n, {_TAGS} AS tag, CASE p % 3 WHEN 1 THEN 'P' ELSE 'S' END AS num, CASE WHEN p % 3 = 2 THEN '3' ELSE '' END AS pers FROM l),
  m AS (SELECT *, CASE tag WHEN 'NOUN' THEN 'noun|' || word || CASE WHEN num = 'P' THEN '-Plur' ELSE '' END || CASE WHEN ends_with(word, 'ing') THEN '-Ger' ELSE '' END
  WHEN 'VERB' THEN 'verb|' || word || '-Inf-' || num || pers WHEN 'PRON' THEN 'pron|' || word || '-Int' || CASE WHEN word IN ('that', 'who') THEN '' ELSE '-' || num || CASE WHEN pers = '' THEN '1' ELSE pers END END
  WHEN 'DET' THEN 'det|' || word || '-Def' || CASE p % 3 WHEN 1 THEN '-Plur' WHEN 2 THEN '-Sing' ELSE '' END WHEN 'ADJ' THEN 'adj|' || word || '-' || num || CASE WHEN pers = '' THEN '1' ELSE pers END ELSE 'adv|' || word END AS mor,
  CASE WHEN p % 6 = 5 THEN p - 1 ELSE p END AS item FROM w)"""
query(
    "h18_tagged_sentence",
    _MOR + """, i AS (SELECT f, u, item, string_agg(mor, '~' ORDER BY p) AS mor FROM m GROUP BY f, u, item), a AS (SELECT f, u, string_agg(mor, ' ' ORDER BY item) AS mor FROM i GROUP BY f, u),
    g AS (SELECT f, u, string_agg((p + 1) || '|' || CASE WHEN p = 0 THEN '0|ROOT' ELSE '1|NMOD-POSS' END, ' ' ORDER BY p) || ' ' || (count(*) + 1) || '|1|PUNCT' AS gra FROM m GROUP BY f, u)
    SELECT f, u, mor, gra FROM a JOIN g USING (f, u)""",
)(lambda s, d: _tagged(s, d).select("f", "u", F.explode_outer(F.array(morphology.tagged_sentence(F.col("sentence"), F.lit("eng")))).alias("t")).where("t.problem is null").select("f", "u", F.array_join("t.mor", " ").alias("mor"), F.array_join("t.gra", " ").alias("gra")))
query("h15_suffixes", _MOR + " SELECT f, u, p, substr(mor, length(tag) + 2 + length(word)) AS s FROM m")(
    lambda s, d: _tagged(s, d).select("f", "u", F.explode(F.filter("sentence", lambda w: w["id_end"].isNull())).alias("w")).select("f", "u", (F.col("w.id") - 1).alias("p"), F.concat(F.lit("-"), F.array_join(morphology.suffixes(F.col("w.upos"), F.lower("w.upos"), words.features_map(F.col("w.feats")), F.col("w.text"), F.col("w.lemma"), F.col("w.deprel"), F.lit("en")), "-")).alias("s"))
    .withColumn("s", F.when(F.col("s") == "-", "").otherwise(F.col("s")))
)
#: Lemmas with their words, and the stems that they leave.
_LEMMAS = (
    ("dog", "dogs", "dog"), ("", "word", "word"), ('"', "said", "said"), ("「", "kg", "kg"), ("0go", "0going", "going"), ("-ing-", "x", "ing"), ("a--b", "x", "a–b"), ("run|walk", "x", "run"), ("new_york", "x", "newyork"),
    ("it's", "x", "its"), ("<SOS>", "surface", "surface"), ("u.s.$", "x", "us"), ("well-known", "x", "well–known"), ("form@s", "x", "form"), ("'", "Claus'", "Claus'"), ("(be)cause", "x", "because"), ("door zogen", "doorzogen", "doorzogen"),
)
_pick = lambda rows, j: "CASE " + " ".join(f"WHEN event_id % {len(rows)} = {k} THEN '" + r[j].replace("'", "\x00") + "'" for k, r in enumerate(rows)) + " END"
_spark = lambda sql: sql.replace("\x00", "\\'")
_sql = lambda sql: sql.replace("\x00", "''")
_scalar("h13_clean_lemma", _spark(f"SELECT event_id AS k, {_pick(_LEMMAS, 0)} AS l, {_pick(_LEMMAS, 1)} AS t FROM {{events}}"), lambda: {"stem": morphology.clean_lemma(F.col("l"), F.col("t"))}, _sql(f"SELECT event_id AS k, {_pick(_LEMMAS, 2)} AS stem FROM events"))
#: Forms by language: lemma, form, and whether irregular; French pronoun and case; French noun and whether its plural is heard; Japanese tag, lemma and form with what they become.
_FORMS = (("go", "went", "1"), ("walk", "walked", "0"), ("BE", "Was", "1"), ("write", "written", "1"), ("go", "goes", "0"), ("wreak", "wrough", "1"))
_FRENCH = (("je", "Nom"), ("Les", "Acc"), ("lui", "Nom"), ("y", ""), ("qu'", ""), ("'tu'", "Nom"))
_NOUNS = (("chevaux", "1"), ("table", "0"), ("Journal", "1"), ("étau", "1"), ("véronals", "1"), ("véronaux", "0"))
_JAPANESE = (("verb", "食べる", "食べちゃ", "sconj:ば"), ("verb", "だ", "x", "aux:た"), ("part", "x", "な", "aux:な"), ("noun", "x", "な", ""), ("verb", "為る", "さ", "part:為る"), ("noun", "物コャミ", "x", "noun:クシャミ"))
_scalar(
    "h16_language_forms",
    _spark(f"SELECT event_id AS k, {_pick(_FORMS, 0)} AS l, {_pick(_FORMS, 1)} AS t, {_pick(_FRENCH, 0)} AS fp, {_pick(_NOUNS, 0)} AS fn, {_pick(_JAPANESE, 0)} AS jt, {_pick(_JAPANESE, 1)} AS jl, {_pick(_JAPANESE, 2)} AS jx FROM {{events}}"),
    lambda: {
        "irregular": morphology.is_irregular(F.col("l"), F.col("t")).cast("int").cast("string"), "kase": F.coalesce(morphology.french_pronoun_case(F.col("fp")), F.lit("")), "heard": morphology.has_audible_plural(F.col("fn")).cast("int").cast("string"),
        "japanese": words.let(morphology.japanese_form(F.col("jt"), F.col("jl"), F.col("jx")), lambda j: F.coalesce(F.concat(j["tag"], F.lit(":"), j["lemma"]), F.lit(""))),
    },
    _sql(f"SELECT event_id AS k, {_pick(_FORMS, 2)} AS irregular, {_pick(_FRENCH, 1)} AS kase, {_pick(_NOUNS, 1)} AS heard, {_pick(_JAPANESE, 3)} AS japanese FROM events"),
)
_HEADS = "[event_id // [1, 7, 49, 343][i + 1] % 7 - 1 FOR i IN range(CAST(user_id % 5 AS BIGINT))]"
query(
    "h19_graph_problems",
    f"""WITH t AS (SELECT event_id AS k, {_HEADS} AS h FROM events), u AS (SELECT *, len(h) AS n, [CASE WHEN h[i] = i OR h[i] < 0 OR h[i] > len(h) THEN 0 ELSE h[i] END FOR i IN range(1, len(h) + 1)] AS up FROM t),
    s1 AS (SELECT *, [CASE WHEN x = 0 THEN 0 ELSE up[x] END FOR x IN up] AS a FROM u), s2 AS (SELECT *, [CASE WHEN x = 0 THEN 0 ELSE up[x] END FOR x IN a] AS b FROM s1),
    s3 AS (SELECT *, [CASE WHEN x = 0 THEN 0 ELSE up[x] END FOR x IN b] AS c FROM s2), s4 AS (SELECT *, [CASE WHEN x = 0 THEN 0 ELSE up[x] END FOR x IN c] AS e FROM s3),
    r AS (SELECT *, len([i FOR i IN range(1, n) IF h[i] = 0 OR h[i] = i]) AS roots FROM s4)
    SELECT k, CASE WHEN n = 0 THEN NULL WHEN roots = 0 THEN 'no root' WHEN roots > 1 THEN 'roots' WHEN len([x FOR x IN e IF x <> 0]) > 0 THEN 'cycle' WHEN len([x FOR x IN h IF x < 0 OR x > n]) > 0 THEN 'missing head' END AS problem FROM r""",
)(lambda s, d: _read(s, d, "SELECT event_id AS k, CASE WHEN user_id % 5 = 0 THEN cast(array() AS array<int>) ELSE transform(sequence(0, cast(user_id % 5 - 1 AS int)), i -> cast(pmod(event_id div array(1, 7, 49, 343)[i], 7) - 1 AS int)) END AS heads FROM {events}").select("k", morphology.graph_problem(F.col("heads")).alias("problem")))
#: Words cut in two after their second character at every third place; every fourth turn's tokens spell something else.
_CUT = "[CASE WHEN k % 3 = 0 AND length(ws[k + 1]) > 2 THEN [substr(ws[k + 1], 1, 2), substr(ws[k + 1], 3)] ELSE [ws[k + 1]] END FOR k IN range(len(ws))]"


def _cut_tokens(s: SparkSession, d: str) -> DataFrame:
    t = _turns(s, d).where(F.size("words") > 0)
    bare = F.transform("words", lambda w: F.translate(w, "()", ""))
    t = t.withColumn("bare", F.filter(bare, lambda w: w != ""))
    cut = F.flatten(F.transform("bare", lambda w, k: F.when((k % 3 == 0) & (F.length(w) > 2), F.array(F.substring(w, 1, 2), F.substring(w, 3, 10_000))).otherwise(F.array(w))))
    return t.where(F.size("bare") > 0).withColumn("tokens", F.when(F.col("u") % 4 == 3, F.concat(cut, F.array(F.lit("x")))).otherwise(cut))


_SHOWN = lambda c: F.array_join(F.transform(c, lambda t: F.concat(t["text"], F.when(t["hint"], "+").when(~t["hint"], "-").otherwise(""))), " ")
_D_BARE = f"SELECT f, u, list_filter([translate(w, '()', '') FOR w IN ws], lambda w: w <> '') AS ws FROM ({D_TURN}) t"
query(
    "c18_realigned",
    f"""WITH b AS (SELECT * FROM ({_D_BARE}) q WHERE len(ws) > 0), c AS (SELECT f, u, ws, {_CUT} AS cs FROM b)
    SELECT f, u, CASE WHEN u % 4 = 3 THEN array_to_string(flatten(cs), ' ') || ' x' ELSE array_to_string([ws[k + 1] || CASE WHEN len(cs[k + 1]) = 1 THEN '' WHEN contains(ws[k + 1], '''') AND lower(trim(string_split(ws[k + 1], '''')[1])) <> 'o' THEN '+' ELSE '-' END FOR k IN range(len(ws))], ' ') END AS t FROM c""",
)(lambda s, d: _cut_tokens(s, d).select("f", "u", _SHOWN(morphology.realigned(F.col("bare"), F.col("tokens"), F.lit("eng"))).alias("t")))
#: Tokens by language and what the rules make of them.
_OVERRIDES = (
    ("fr", "aujourd'hui", "aujourd'hui"), ("fr", "Au", "Au+"), ("fr", "d'l'attraper", "d'- l'- attraper-"), ("fr", "jusqu'à", "jusqu'- à-"), ("fr", "maison", "maison"), ("fr", "l'eau", "l'eau"), ("it", "Le i", "lei"), ("it", "le x i", "le x i"),
    ("pt", "D'água", "D'água+"), ("nl", "Jan's", "Jan's-"), ("de", "au le i", "au le i"), ("it", "le i i", "lei i"),
)
_scalar("h20_overrides", _spark(f"SELECT event_id AS k, {_pick(_OVERRIDES, 0)} AS lang, {_pick(_OVERRIDES, 1)} AS t FROM {{events}}"),
        lambda: {"t": _SHOWN(morphology.overridden(F.transform(F.split("t", " "), lambda x: F.struct(x.alias("text"), F.lit(None).cast("boolean").alias("hint"))), F.col("lang")))}, _sql(f"SELECT event_id AS k, {_pick(_OVERRIDES, 2)} AS t FROM events"))
query(
    "h28_retokenized",
    f"""WITH b AS (SELECT * FROM ({_D_BARE}) q WHERE len(ws) > 0 AND u % 4 <> 3 AND len([w FOR w IN ws IF w IN ('.', '?', '!')]) = 0), c AS (SELECT f, u, ws, {_CUT} AS cs FROM b)
    SELECT f, u, '&~eh ' || array_to_string([CASE WHEN len(cs[k + 1]) = 2 AND cs[k + 1][2] IN ('.', '?', '!') THEN cs[k + 1][1] || ' ' || ws[k + 1] ELSE array_to_string(cs[k + 1], ' ') END FOR k IN range(len(ws))], ' ') AS t, len(flatten(cs))::BIGINT AS tags FROM c""",
)(
    lambda s, d: _cut_tokens(s, d).where(~F.exists("bare", lambda w: w.isin(".", "?", "!")) & (F.col("u") % 4 != 3))
    .select("f", "u", morphology.retokenized(F.concat(F.array(F.struct(F.lit("&~eh").alias("text"), F.lit("other").alias("kind"))), F.transform("bare", lambda w: F.struct(w.alias("text"), F.lit("word").alias("kind")))), F.col("tokens")).alias("r"))
    .select("f", "u", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("t"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["tags"]).alias("tags"))
)

# --- comparison and recovery -------------------------------------------------------------

#: Words that no other place of a file has.
_UNIQUE = f"SELECT f, u, p, role, 'w' || u || 'x' || p AS word FROM ({D_WORDS}) t"


def _unique(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d).select("f", "u", "p", F.concat(F.lit("w"), "u", F.lit("x"), "p").alias("word"))


@query("c5_compare")
def _compare(s: SparkSession, d: str) -> DataFrame:
    """Each benchmark text against itself with every seventh word changed and every eleventh gone, in utterances of ten words."""
    from parlance.plans.catalog import _compared

    utt = lambda ws: F.struct(ws.alias("words"), F.transform(ws, lambda w: F.when(F.length(w) > 5, "noun").otherwise("x")).alias("tags"), F.lit(".").alias("terminator"))
    t = _compared(s, d).select("f", F.array(utt(F.col("main"))).alias("main"), F.transform(tens("gold"), utt).alias("gold"))
    return sequence.compared(t)


def tens(name: str) -> Column:
    """An array's items, all of them, as arrays of ten at most; none for an empty array."""
    return F.expr(f"if(size({name}) > 0, transform(sequence(1, size({name}), 10), k -> slice({name}, k, 10)), array())")


def _projection(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold turns and main turns: of each three turns one is the same, one has a word more in main, one has another second word there."""
    w = _unique(s, d).groupBy("f", "u").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]).alias("words"))
    w = w.where(F.size("words") > 2).withColumn("k", F.dense_rank().over(_ordered("f", "u")) - 1)
    other = F.array(F.concat(F.lit("other"), F.col("u")))
    more, instead = (F.concat(F.slice("words", 1, 1), other, F.slice("words", at, F.size("words"))) for at in (2, 3))
    w = w.withColumn("m", F.when(F.col("k") % 3 == 1, more).when(F.col("k") % 3 == 2, instead).otherwise(F.col("words")))
    utt = lambda c: F.struct(F.col(c).alias("words"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("terminator"))
    t = w.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("k", utt("m").alias("m"), utt("words").alias("g")))).alias("t"))
    tokens = sequence.compared(t.select("f", F.transform("t", lambda x: x["m"]).alias("main"), F.transform("t", lambda x: x["g"]).alias("gold")))
    mor = lambda c: F.transform(c, lambda x: F.concat(F.lit("n|"), x))
    side = lambda c, tiers_: w.select("f", F.col("k").cast("int").alias("utt"), F.size(c).alias("n_compared"), F.size(c).alias("n_words"), mor(c).alias("mor"), tiers_.alias("tiers"))
    m = side("m", F.create_map(F.lit("mor"), F.array_join(mor("m"), " "), F.lit("gra"), F.lit("g"), F.lit("wor"), F.lit("w"), F.lit("com"), F.lit("c")))
    g = w.select("f", F.col("k").cast("int").alias("utt"), F.size("words").alias("n_compared"), F.size("words").alias("n_words"), F.array().cast("array<string>").alias("mor"), F.create_map(F.lit("com"), F.lit("own")).alias("tiers"))
    return tokens, m, g


def _ordered(f: str, u: str):
    from pyspark.sql import Window

    return Window.partitionBy(f).orderBy(u)


query(
    "c6_gold_projection",
    f"""WITH w AS (SELECT f, u, list('n|' || word ORDER BY p) AS ws FROM ({_UNIQUE}) t GROUP BY f, u HAVING count(*) > 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY f ORDER BY u) - 1 AS INTEGER) AS utt FROM w)
    SELECT f, utt, CASE WHEN utt % 3 < 2 THEN array_to_string(ws, ' ') END AS mor, CASE WHEN utt % 3 = 0 THEN 'g' END AS gra, CASE WHEN utt % 3 = 0 THEN 'w' END AS wor, 'own' AS com FROM k""",
)(lambda s, d: sequence.gold_projection(*_projection(s, d)).select("f", "utt", *[F.col("tiers")[n].alias(n) for n in ("mor", "gra", "wor", "com")]))
query("d1_compare_metrics", f"""WITH w AS (SELECT f, u, count(*) AS n FROM ({_UNIQUE}) t GROUP BY f, u HAVING count(*) > 2), k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY u) - 1 AS k FROM w),
    m AS (SELECT f, sum(CASE WHEN k % 3 = 2 THEN n - 1 ELSE n END)::BIGINT AS matches, count(*) FILTER (k % 3 > 0) AS insertions, count(*) FILTER (k % 3 = 2) AS deletions, sum(n)::BIGINT AS gold FROM k GROUP BY f)
    SELECT *, (insertions + deletions) / gold AS wer, greatest(0.0, least(1.0, 1 - (insertions + deletions) / gold)) AS accuracy FROM m""")(lambda s, d: sequence.compare_metrics(_projection(s, d)[0]))  # fmt: skip


def _recoverable(s: SparkSession, d: str) -> DataFrame:
    """Files of turns without times but for every fourth, and tokens of four words in five."""
    w = _unique(s, d)
    u = w.groupBy("f", "u").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]).alias("words"))
    timed = F.col("u") % 4 == 1
    u = u.select(
        "f", F.struct(F.col("u").cast("int").alias("u"), (F.col("u") % 2).cast("string").alias("speaker"), "words", F.when(timed, F.col("u") * 1_000_000).cast("long").alias("start_ms"), F.when(timed, F.col("u") * 1_000_000 + 500).cast("long").alias("end_ms"),
                      F.lit(False).alias("lazy"), F.array().cast("array<int>").alias("bottoms"), F.array().cast("array<struct<number:int,fraction:double>>").alias("tops")).alias("x")
    )
    heard = w.where("p % 5 != 3").select("f", F.struct((F.col("u") * 1000 + F.col("p")).alias("k"), F.upper("word").alias("text"), ((F.col("u") * 1000 + F.col("p")) * 300).cast("long").alias("start_ms"), ((F.col("u") * 1000 + F.col("p")) * 300 + 250).cast("long").alias("end_ms")).alias("t"))
    tokens = heard.groupBy("f").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["text"].alias("text"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))).alias("tokens"))
    return u.groupBy("f").agg(F.array_sort(F.collect_list("x")).alias("utterances")).join(tokens, "f")


_C10 = f"""SELECT f, u, CASE WHEN u % 4 = 1 THEN u * 1000000 ELSE min(CASE WHEN p % 5 <> 3 THEN (u * 1000 + p) * 300 END) END AS start_ms, CASE WHEN u % 4 = 1 THEN u * 1000000 + 500 ELSE max(CASE WHEN p % 5 <> 3 THEN (u * 1000 + p) * 300 + 250 END) END AS end_ms FROM ({_UNIQUE}) t GROUP BY f, u"""
query("c10_recovered_timing", _C10)(lambda s, d: recovery.recovered_timing(_recoverable(s, d)).select("f", F.col("u").cast("long").alias("u"), "start_ms", "end_ms"))
query("c10_recovery_counts", f"SELECT f, count(*) FILTER (u % 4 <> 1 AND start_ms IS NOT NULL) AS injected, count(*) FILTER (u % 4 = 1) AS skipped, count(*) FILTER (start_ms IS NULL) AS unmatched FROM ({_C10}) t GROUP BY f")(
    lambda s, d: recovery.recovery_counts(recovery.recovered_timing(_recoverable(s, d)))
)
query("u6_recovery_strategy", _C10)(lambda s, d: recovery.recover(_recoverable(s, d), "auto").select("f", F.col("u").cast("long").alias("u"), "start_ms", "end_ms"))


def _overlapping(s: SparkSession, d: str) -> DataFrame:
    """As ``_recoverable``, untimed, with every sixth turn overlapping the one before, which has a mark at its middle, and its words heard there."""
    w = _unique(s, d)
    u = w.groupBy("f", "u").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]).alias("words"))
    lazy = F.col("u") % 6 == 5
    top = F.array(F.struct(F.lit(1).alias("number"), F.lit(0.5).alias("fraction")))
    none = F.array().cast("array<struct<number:int,fraction:double>>")
    u = u.select("f", F.struct(F.col("u").cast("int").alias("u"), (F.col("u") % 2).cast("string").alias("speaker"), "words", F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), lazy.alias("lazy"), F.array().cast("array<int>").alias("bottoms"), F.when(F.col("u") % 6 == 4, top).otherwise(none).alias("tops")).alias("x"))
    # The words of an overlapping turn are heard soon after the turn before begins, between those of the turn before.
    at = (F.when(lazy, (F.col("u") - 1) * 10_000 + 10).otherwise(F.col("u") * 10_000) + F.col("p") * 8) * 10
    heard = w.select("f", F.struct(at.alias("k"), "word", at.cast("long").alias("start_ms"), (at + 70).cast("long").alias("end_ms")).alias("t"))
    tokens = heard.groupBy("f").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["word"].alias("text"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))).alias("tokens"))
    return u.groupBy("f").agg(F.array_sort(F.collect_list("x")).alias("utterances")).join(tokens, "f")


#: Where overlapping turns are few enough to be left out at first, other turns get the spans of their words, and each of them that of
#: its words in the first of three windows around the turn before that holds any.
_BUFFERS = (recovery.TwoPass().tight_ms, "greatest(len, 2000)", "greatest(2 * len, 5000)")
query(
    "c11_two_pass_timing",
    f"""WITH w AS (SELECT *, (CASE WHEN u % 6 = 5 THEN (u - 1) * 10000 + 10 ELSE u * 10000 END + p * 8) * 10 AS a FROM ({_UNIQUE}) t),
    t AS (SELECT f, u, min(a) AS start_ms, max(a) + 70 AS end_ms FROM w GROUP BY f, u),
    x AS (SELECT t.f, t.u, b.start_ms + floor((b.end_ms - b.start_ms) * 0.5)::BIGINT AS anchor, b.end_ms AS pe, b.end_ms - b.start_ms AS len FROM t JOIN t b ON b.f = t.f AND b.u = t.u - 1 WHERE t.u % 6 = 5),
    y AS (SELECT x.f, x.u, {", ".join(f"min(a) FILTER (a < pe + {n} AND a + 70 > greatest(0, anchor - {n})) AS s{k}, max(a) FILTER (a < pe + {n} AND a + 70 > greatest(0, anchor - {n})) + 70 AS e{k}" for k, n in enumerate(_BUFFERS))}
    FROM x JOIN w USING (f, u) GROUP BY x.f, x.u)
    SELECT f, u, start_ms, end_ms FROM t WHERE u % 6 <> 5 UNION ALL SELECT f, u, coalesce(s0, s1, s2), coalesce(e0, e1, e2) FROM y
    UNION ALL SELECT f, u, start_ms, end_ms FROM t WHERE u % 6 = 5 AND (f, u) NOT IN (SELECT (f, u) FROM x)""",
)(lambda s, d: recovery.two_pass_timing(_overlapping(s, d), recovery.TwoPass(mode="caseless")).select("f", F.col("u").cast("long").alias("u"), "start_ms", "end_ms"))
query(
    "c13_overlap_onsets",
    f"""WITH x AS (SELECT DISTINCT f, u FROM ({_UNIQUE}) t), y AS (SELECT f, u, u % 2 AS sp FROM x)
    SELECT a.f, a.u, CASE WHEN count(*) FILTER (b.u % 6 = 4 AND b.u < a.u) > 0 THEN 0.5 END AS onset FROM y a LEFT JOIN y b ON b.f = a.f GROUP BY a.f, a.u""",
)(lambda s, d: recovery.overlap_onsets(_overlapping(s, d)).select("f", F.col("u").cast("long").alias("u"), "onset"))


@query("c9_unique_places", "SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN NULL ELSE '0 2 4 6' END AS places FROM events")
def _unique_places(s: SparkSession, d: str) -> DataFrame:
    """Four words among tokens with others between: all in one way, or twice at the end, or one missing."""
    t = _read(s, d, "SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN 'A x b y C z D d' WHEN event_id % 5 = 0 THEN 'a x b y c z e w' ELSE 'A x b y C z D w' END AS t FROM {events}")

    @F.pandas_udf("string")
    def places(tokens: pd.Series) -> pd.Series:
        found = tokens.map(lambda x: recovery.unique_places("a b c d".split(), x.split(" ")))
        return found.map(lambda x: None if x is None else " ".join(map(str, x)))

    return t.select("k", places("t").alias("places"))


query("c14_stitched", f"SELECT f, u AS g, CAST(p AS INTEGER) AS p, 100 + p * 500 AS start_ms, CASE WHEN p + 1 < n THEN 100 + (p + 1) * 500 ELSE 600 + p * 500 END AS end_ms FROM (SELECT *, count(*) OVER (PARTITION BY f, u) AS n FROM ({_UNIQUE}) t) q")(
    lambda s, d: sequence.stitched(
        _unique(s, d).groupBy("f", "u").agg(F.array_sort(F.collect_list(F.struct("p", "word"))).alias("t")).select(
            "f", F.col("u").alias("g"), F.transform("t", lambda x: F.upper(x["word"])).alias("words"), F.lit(100).alias("offset_ms"),
            F.concat(F.array(F.struct(F.lit("<|0.00|>").alias("text"), F.lit(0.0).alias("time_s"))), F.flatten(F.transform("t", lambda x: F.array(F.struct(F.substring(x["word"], 1, 2).alias("text"), (x["p"] * 0.5).cast("double").alias("time_s")), F.struct(F.concat(F.substring(x["word"], 3, 50), F.lit(",")).alias("text"), (x["p"] * 0.5 + 0.25).cast("double").alias("time_s")))))).alias("tokens"),
        )
    ).selectExpr("f", "g", "p", "start_ms", "end_ms")
)

# --- words, trees and numbers --------------------------------------------------------------

_RULES = "".join(f" WHEN contains(w, '{m.replace(chr(39), chr(39) * 2)}') THEN [string_split(w, '''')[1], '{v}']" for m, v in sequence.CLITICS)
_SPOKEN = "".join(f" WHEN w = '{k.replace(chr(39), chr(39) * 2)}' THEN [" + ", ".join("'" + x.replace("'", "''") + "'" for x in v.split(" ")) + "]" for k, v in sequence.EXPANSIONS.items())
query(
    "h1_conformed",
    f"""SELECT f, u, x AS word FROM (SELECT f, u, CASE WHEN w = 'nothing' THEN ['no', 'thing'] WHEN bare IN ('USA', 'TV') THEN string_split(bare, ''){_RULES} WHEN w IN ({", ".join(f"'{x}'" for x in sorted(sequence.HESITATIONS))}) THEN ['um']
    WHEN contains(w, '-') THEN [trim(x) FOR x IN string_split(w, '-')] WHEN w IN ('mary', 'john') THEN ['name']{_SPOKEN} ELSE string_split(w, '_') END AS xs FROM (SELECT f, u, trim(word) AS bare, lower(trim(word)) AS w FROM ({D_WORDS}) t) q) z, unnest(xs) AS r(x)""",
)(lambda s, d: _turns(s, d).where(F.size("words") > 0).select("f", "u", F.explode(sequence.conformed(F.col("words"), {"nothing": ("no", "thing")}, frozenset({"USA", "TV"}), frozenset({"mary", "john"}))).alias("word")))
_NAMES = "['', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen']"
_SMALL = lambda x: f"CASE WHEN {x} = 0 THEN '' WHEN {x} < 20 THEN {_NAMES}[{x} + 1] ELSE ['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety'][{x} // 10 - 1] || CASE WHEN {x} % 10 > 0 THEN ' ' || {_NAMES}[{x} % 10 + 1] ELSE '' END END"
_SAID = f"""trim(CASE WHEN n >= 2000 THEN {_NAMES}[n // 1000 + 1] || ' thousand ' WHEN n >= 1000 THEN 'thousand ' ELSE '' END || CASE WHEN n % 1000 >= 200 THEN {_NAMES}[n % 1000 // 100 + 1] || ' hundred ' WHEN n % 1000 >= 100 THEN 'hundred ' ELSE '' END || {_SMALL("n % 100")})"""
#: Numbers plain, between dashes, with a currency before or behind, and in words that only hold digits.
_NUMBER = "SELECT l_orderkey AS k, l_linenumber AS j, CAST(l_quantity AS BIGINT) * 137 AS n FROM {lineitem}"
query(
    "h2_spoken_numbers",
    f"SELECT k, j, CASE k % 6 WHEN 0 THEN t WHEN 1 THEN t || ' five' WHEN 2 THEN t || ' dollars' WHEN 3 THEN t || ' euros' WHEN 4 THEN 'COVID-' || n ELSE 'x' || n END AS w FROM (SELECT *, {_SAID} AS t FROM {_duck(_NUMBER)} q) z",
)(
    lambda s, d: _read(s, d, _NUMBER).select("k", "j", F.expr("CASE k % 6 WHEN 0 THEN cast(n as string) WHEN 1 THEN concat(n, '—5') WHEN 2 THEN concat('$', n) WHEN 3 THEN concat(n, '€') WHEN 4 THEN concat('COVID–', n) ELSE concat('x', n) END").alias("w"))
    .select("k", "j", F.array_join(sequence.spoken_numbers(F.array("w"), _english()), " ").alias("w"))
)


#: Names of English numbers, for this query; callers bring their own language's.
ENGLISH = dict(zip([*range(1, 21), *range(30, 100, 10), 100, 1000, 10**6], "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split(), strict=True))


def _english() -> dict[int, str]:
    return ENGLISH


#: Trees over a turn's words: two clauses around a conjunction.
query(
    "e14_utterance_groups",
    f"""WITH t AS (SELECT f, u, len(ws) AS n, len(ws) // 2 AS h FROM ({D_TURN}) t WHERE len(ws) > 2) SELECT f, u, array_to_string([CASE WHEN h >= 3 AND n - h >= 3 AND p >= h THEN '1' ELSE '0' END FOR p IN range(n)], '') AS g FROM t""",
)(
    lambda s, d: _turns(s, d).where(F.size("words") > 2).withColumn("h", F.floor(F.size("words") / 2).cast("int"))
    .withColumn("leaves", F.transform("words", lambda w, k: F.concat(F.lit("(X t"), k, F.lit(")"))))
    .withColumn("t", F.concat(F.lit("(S (S "), F.array_join(F.slice("leaves", 1, F.col("h")), " "), F.lit(") (Conj x) (S "), F.array_join(F.slice("leaves", F.col("h") + 2, F.size("words")), " "), F.lit("))")))
    .select("f", "u", F.array_join(sequence.utterance_groups_of(F.array("t"), F.size("words")), "").alias("g"))
)
_scalar("h21_tree_ranges", "SELECT event_id AS k, event_id % 4 AS j FROM {events}", lambda: {"g": _tree_text(F.col("j"))}, "SELECT event_id AS k, CASE event_id % 4 WHEN 0 THEN '0 1|3 4 5' WHEN 1 THEN '0 1|3 4 5|3|5' WHEN 2 THEN '' END AS g FROM events")


def _tree_text(j: Column) -> Column:
    trees = ("(S (S a b) (cc c) (S d e f))", "(ROOT (S a b) (CC x) (S (S d) (CONJ e) (S f)))", "(S (S a) (S b))", "(S (S a")

    @F.pandas_udf("string")
    def run(xs: pd.Series) -> pd.Series:
        def text(k: int) -> str | None:
            try:
                return "|".join(" ".join(map(str, r)) for r in sequence.tree_ranges(trees[k]))
            except ValueError:
                return None

        return xs.map(text)

    return run(j)


#: First letters of words; known are all pairs of letters up to m, so that runs merge two by two.
_PAIRS = frozenset(a + b for a in "ABCDEFGHIJKLM" for b in "ABCDEFGHIJKLM")
query(
    "e15_letters_merged",
    f"""WITH w AS (SELECT f, u, p, CASE WHEN regexp_matches(word, '^[A-Za-z]') THEN substr(word, 1, 1) ELSE word END AS x FROM ({D_WORDS}) t), n AS (SELECT *, coalesce(regexp_matches(x, '^[A-Ma-m]$') AND regexp_matches(lead(x) OVER (PARTITION BY f, u ORDER BY p), '^[A-Ma-m]$'), false) AS m, lead(x) OVER (PARTITION BY f, u ORDER BY p) AS nx FROM w),
    r AS (SELECT *, p - row_number() OVER (PARTITION BY f, u, m ORDER BY p) AS run FROM n), g AS (SELECT *, m AND row_number() OVER (PARTITION BY f, u, m, run ORDER BY p) % 2 = 1 AS merge FROM r),
    o AS (SELECT *, coalesce(lag(merge) OVER (PARTITION BY f, u ORDER BY p), false) AS gone FROM g) SELECT f, u, string_agg(CASE WHEN merge THEN x || nx ELSE x END, ' ' ORDER BY p) AS w FROM o WHERE NOT gone GROUP BY f, u""",
)(lambda s, d: _turns(s, d).where(F.size("words") > 0).select("f", "u", F.array_join(sequence.letters_merged(F.transform("words", lambda w: F.when(F.rlike(w, F.lit("^[A-Za-z]")), F.substring(w, 1, 1)).otherwise(w)), _PAIRS), " ").alias("w")))
_scalar("g1_without_subsets", "SELECT event_id AS k, cast(event_id % 5 + 1 as int) AS a, cast(user_id % 5 + 1 as int) AS b FROM {events}", lambda: {"n": F.array_join(F.transform(records.without_subsets(F.array(F.sequence(F.lit(1), F.col("a")), F.sequence(F.lit(3), F.lit(3) + F.col("b")))), lambda r: F.size(r)), " ")},
        "SELECT k, CASE WHEN b + 1 >= a THEN (b + 1) || CASE WHEN least(a, 2) > 0 THEN ' ' || least(a, 2) ELSE '' END ELSE a || CASE WHEN b + 3 > greatest(a, 2) THEN ' ' || (b + 3 - greatest(a, 2)) ELSE '' END END AS n FROM (SELECT event_id AS k, event_id % 5 + 1 AS a, user_id % 5 + 1 AS b FROM events) t")
_scalar(
    "h6_cantonese_characters", "SELECT doc_id AS k, concat('你 ', text, '好，', lang) AS t FROM {documents}", lambda: {"c": F.array_join(words.cantonese_characters(F.col("t")), "|")},
    r"SELECT doc_id AS k, array_to_string(regexp_extract_all('你' || regexp_replace(text, '\s', '', 'g') || '好' || lang, '(?s).'), '|') AS c FROM documents",
)

# --- stores and streams --------------------------------------------------------------------

query("f1_attempts_in_order", "SELECT job_id, attempt, row_number() OVER (PARTITION BY job_id ORDER BY started_at, attempt)::INTEGER AS rank FROM (SELECT l_orderkey AS job_id, l_linenumber AS attempt, l_suppkey % 5 AS started_at FROM lineitem) t")(
    lambda s, d: store.attempts_in_order(_read(s, d, "SELECT l_orderkey AS job_id, l_linenumber AS attempt, l_suppkey % 5 AS started_at FROM {lineitem}")).select("job_id", "attempt", "rank")
)
query("f3_next_wake", "SELECT min(greatest(CASE WHEN l > 50000 THEN l END, CASE WHEN e > 50000 THEN e END))::DOUBLE AS wake FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 97) * 1000 END AS l, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 89) * 1000 END AS e FROM orders WHERE o_orderkey % 6 = 0) t WHERE l > 50000 OR e > 50000")(
    lambda s, d: store.next_wake(_read(s, d, "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 6 = 0 THEN 'queued' ELSE 'done' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN CAST((o_orderkey % 97) * 1000 AS DOUBLE) END AS lease_expires_at, CASE WHEN o_orderkey % 5 = 0 THEN CAST((o_orderkey % 89) * 1000 AS DOUBLE) END AS next_eligible_at FROM {orders}"), 50_000.0)
)
_TIER = "SELECT p_partkey AS key, 't' AS task, CASE WHEN p_partkey % 7 = 0 THEN 'v1' ELSE 'v2' END AS engine_version, p_size AS data, CAST(p_partkey AS DOUBLE) AS used_at FROM {part}"


@query("g7_tiered_cache", "SELECT p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 AND p_partkey > (SELECT max(p_partkey) FROM part) - 900 THEN 'hot' WHEN p_partkey % 2 = 0 THEN 'cold' END AS tier FROM part")
def _tiered(s: SparkSession, d: str) -> DataFrame:
    every = _read(s, d, _TIER)
    last = every.agg(F.max("used_at")).first()[0]
    hot = store.hot_entries(every.where("key % 3 = 0"), every.limit(0), last, 300, 10**9)
    return store.tiered_get(every.select("key", "task"), hot, every.where("key % 2 = 0"), "v2").select("key", "tier")


query("d14_functionals", "SELECT l_orderkey AS f, concat('f', l_linenumber % 2) AS name, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS deviation, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1, 2")(
    lambda s, d: records.functionals(_read(s, d, "SELECT l_orderkey AS f, l_linenumber AS frame, concat('f', l_linenumber % 2) AS name, l_quantity AS value FROM {lineitem}"))
)
_EVENTS = "SELECT user_id % 50 AS job_id, concat('file', user_id % 3) AS filename, event_id, CASE event_type WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'view' THEN 'attempt' ELSE 'retry' END AS kind, CAST(event_id AS DOUBLE) AS at, concat('c', event_id % 4) AS category, CAST(event_id + 30 AS DOUBLE) AS retry_at FROM {events}"
_S4 = f"""SELECT job_id, filename, CASE WHEN kind IN ('done', 'error') THEN kind ELSE 'processing' END AS status, CASE WHEN kind IN ('error', 'retry') THEN category END AS category, started_at, CASE WHEN kind IN ('error', 'retry', 'done') THEN last_at END AS finished_at,
  CASE WHEN kind = 'retry' THEN retry_at END AS next_eligible_at, CASE WHEN kind = 'retry' THEN 'retry_scheduled' END AS stage, attempts FROM (SELECT job_id, filename, arg_max(kind, event_id) AS kind, arg_max(category, event_id) AS category, max("at") AS last_at, max(retry_at) AS retry_at,
  max("at") FILTER (kind IN ('processing', 'attempt')) AS started_at, count(*) FILTER (kind = 'attempt') AS attempts FROM {_duck(_EVENTS).replace(" AS at,", ' AS "at",')} e GROUP BY job_id, filename) t"""
query("s4_file_states", _S4)(lambda s, d: feed.file_states(_read(s, d, _EVENTS)))


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("s4_file_states_stream", _S4)
def _states_stream(s: SparkSession, d: str) -> DataFrame:
    exprs = _EVENTS.removeprefix("SELECT ").removesuffix(" FROM {events}")
    stream = _event_stream(s, d)
    stream.createOrReplaceTempView("s4_events")
    return feed.run_to_table(s, feed.file_states(s.sql(f"SELECT {exprs} FROM s4_events")), "file_states")


query("s3_progress", "SELECT user_id % 100 AS job_id, max(event_id % 77) AS done FROM events GROUP BY 1")(
    lambda s, d: feed.run_to_table(s, feed.progress(_event_stream(s, d).selectExpr("user_id % 100 as job_id", "event_id % 77 as done")), "progress")
)


@query("s2_until_terminal", "SELECT job_id, event_id FROM (SELECT user_id % 100 AS job_id, event_id, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id % 100) AS stop FROM events) t WHERE stop IS NULL OR event_id <= stop")
def _until_terminal(s: SparkSession, d: str) -> DataFrame:
    kept: list[DataFrame] = []
    feed.until_terminal(_read(s, d, "SELECT user_id % 100 AS job_id, event_id, event_type AS status FROM {events}"), kept.append)
    return kept[0].select("job_id", "event_id")


query("s5_leases")(lambda s, d: feed.lease_table(_read(s, d, "SELECT user_id % 100 AS job_id, event_id, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' WHEN 'error' THEN 'release' ELSE 'renew' END AS kind, concat('n', event_id % 3) AS node, CAST(event_id AS DOUBLE) AS at FROM {events}")))
#: Tokens 300 ms apart with a pause after every fifth.
_SPOKEN_AT = "SELECT user_id % 10 AS f, event_id, timestamp_millis(event_id * 3000 + (event_id % 10) * 11) AS at, event_type AS word FROM {events}"
query(
    "s6_assembled",
    """WITH t AS (SELECT user_id % 10 AS f, event_id * 3000 + (event_id % 10) * 11 AS ms, event_type AS word FROM events), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY f ORDER BY ms) <= 20000 THEN 0 ELSE 1 END AS fresh FROM t),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY f ORDER BY ms) AS s FROM g) SELECT f, min(ms) AS start_ms, max(ms) AS end_ms, string_agg(word, ' ' ORDER BY ms) AS words FROM i GROUP BY f, s""",
)(lambda s, d: feed.assembled(_read(s, d, _SPOKEN_AT), 20_000).select("f", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "words"))
query("s7_rerun", "SELECT conv_id AS f, turn AS after_idx, CASE WHEN turn % 4 = 2 THEN 'new ' || length(coalesce(text, '')) WHEN turn % 5 = 3 THEN 'new ' || length(coalesce(text, '')) ELSE 'old ' || turn END AS result FROM conversations")(
    lambda s, d: feed.rerun(
        _read(s, d, "SELECT conv_id AS f, turn AS after_idx, coalesce(text, '') AS text FROM {conversations}"),
        _read(s, d, "SELECT conv_id AS f, turn AS after_idx, turn AS before_idx, CASE WHEN turn % 4 = 2 THEN 'words_changed' WHEN turn % 3 = 0 THEN 'timing_only' ELSE 'unchanged' END AS kind FROM {conversations}"),
        _read(s, d, "SELECT conv_id AS f, turn AS before_idx, concat('old ', turn) AS result FROM {conversations} WHERE turn % 5 <> 3"),
        lambda rows: rows.select("f", "after_idx", F.concat(F.lit("new "), F.length("text")).alias("result")),
    )
)


@query("u3_infer", "SELECT text, lang, 'x ' || text AS translation FROM (SELECT DISTINCT coalesce(text, '') AS text, 'eng' AS lang FROM conversations) t")
def _infer(s: SparkSession, d: str) -> DataFrame:
    models.register("translate", _echo, "text string, lang string, translation string")
    return models.infer(_read(s, d, "SELECT DISTINCT coalesce(text, '') AS text, 'eng' AS lang FROM {conversations}"), "translate")


def _echo(batches):
    for b in batches:
        yield b.assign(translation="x " + b["text"])


def _tagger(batches):
    """Stands for a model: tags by length and features by place, as ``_MOR`` does."""
    tags, feats = ("NOUN", "VERB", "PRON", "DET", "ADJ", "ADV"), (None, "Number=Plur", "Number=Sing|Person=3")
    for b in batches:
        sentences = [[{"id": k + 1, "id_end": None, "decimal": False, "text": w, "lemma": w, "upos": tags[len(w) % 6], "feats": feats[k % 3], "head": int(k > 0), "deprel": "dep" if k else "root"} for k, w in enumerate(ws)] for ws in b["words"]]
        yield b[["f", "line_idx", "terminator", "lang"]].assign(sentence=sentences)


@query("u8_morphotag", _MOR + " SELECT f, u AS line_idx, string_agg(mor, ' ' ORDER BY p) || ' .' AS mor FROM m GROUP BY f, u")
def _morphotag(s: SparkSession, d: str) -> DataFrame:
    models.register("morphosyntax", _tagger, "f bigint")
    bare = F.filter(F.transform("words", lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z]", ""))), lambda w: w != "")
    t = _turns(s, d).select("f", F.col("u").alias("line_idx"), bare.alias("words"), F.lit(None).cast("string").alias("terminator"), F.lit(None).cast("string").alias("lang"), F.array(F.lit("eng")).alias("declared"), F.create_map().cast("map<string,string>").alias("tiers"))
    return commands.morphotag(t).select("f", "line_idx", "mor")


query("u8_benchmark")(lambda s, d: commands.benchmark(_compared_pairs(s, d)))


def _compared_pairs(s: SparkSession, d: str) -> DataFrame:
    from parlance.plans.catalog import _compared

    return _compared(s, d).select("f", F.col("main").alias("hypothesis"), F.col("gold").alias("reference"))


query("u8_transcribe")(lambda s, d: commands.transcribe(_read(s, d, "SELECT conv_id AS f, turn * 1000 AS i, coalesce(text, '') AS value, CAST(turn * 60 AS DOUBLE) AS ts, CAST(turn * 60 + 50 AS DOUBLE) AS end_ts FROM {conversations}")))
query("u8_utseg", f"""WITH t AS (SELECT f, u, ws, len(ws) AS n, len(ws) // 2 AS h FROM ({D_TURN}) t WHERE len(ws) > 2), p AS (SELECT *, h >= 3 AND n - h >= 3 AS two FROM t)
    SELECT f, u, 0 AS part, CASE WHEN two THEN array_to_string(ws[1:h], ' ') || ' .' ELSE array_to_string(ws, ' ') END AS words FROM p UNION ALL SELECT f, u, 1, array_to_string(ws[h + 1:n], ' ') || ' .' FROM p WHERE two""")(
    lambda s, d: commands.utseg(
        _turns(s, d).where(F.size("words") > 2).withColumn("h", F.floor(F.size("words") / 2).cast("int")).withColumn("leaves", F.transform("words", lambda w, k: F.concat(F.lit("(X t"), k, F.lit(")"))))
        .select("f", "u", "words", F.array(F.concat(F.lit("(S (S "), F.array_join(F.slice("leaves", 1, F.col("h")), " "), F.lit(") (Conj x) (S "), F.array_join(F.slice("leaves", F.col("h") + 2, F.size("words")), " "), F.lit("))"))).alias("trees"))
    ).select("f", "u", F.col("part").cast("int").alias("part"), F.array_join("words", " ").alias("words"))
)

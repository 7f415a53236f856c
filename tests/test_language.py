"""Languages told by trigram profiles: agreement on held-out documents, scripts, ties and short texts."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from parlance.functions import language
from parlance.operators import words

D = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_documents_agree_with_their_language(spark):
    docs = spark.read.parquet(D).where("lang is not null and text is not null").select("doc_id", "text", "lang")
    seen = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    detect = language.detector(language.profiles(docs.where(seen)))
    got = docs.where(~seen).select("lang", words.is_detectable(F.col("text")).alias("long"), words.detected_language(F.col("text"), detect).alias("told")).where("long").collect()
    told = [r for r in got if r.told is not None]
    assert len(got) > 100 and len(told) >= 0.9 * len(got)
    assert sum(r.told == r.lang for r in told) >= 0.98 * len(told)


def test_profiles_rank_by_count_and_then_by_trigram(spark):
    rows = [("abc abc", "x"), ("Abd!", "x"), (None, "x"), ("zz", None), ("", "y"), ("q", "y")]
    got = {(r.lang, r.gram): r["rank"] for r in language.profiles(spark.createDataFrame(rows, "text string, lang string")).collect()}
    assert got == {("x", " ab"): 1, ("x", "abc"): 2, ("x", "bc "): 3, ("x", "abd"): 4, ("x", "bd "): 5, ("x", "c a"): 6, ("y", " q "): 1}
    assert language.profiles(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_scripts_ties_and_texts_without_letters():
    ranks = {"aaa": {" ab": 1, "abc": 2}, "bbb": {" ab": 1, "abc": 2}, "ccc": {"xyz": 1}}
    assert language.told("abc", ranks) == ("aaa", 0.0)  # a tie: the first name, without confidence
    assert language.told("123 !?", ranks) == (None, 0.0) and language.told("", ranks) == (None, 0.0)
    assert language.told("qqq www", ranks) == (None, 0.0)  # nothing in common with any profile
    assert language.told("안녕하세요 여러분", {}) == ("kor", 1.0) and language.told("今日はとても良い天気ですね", {}) == ("jpn", 1.0)
    assert language.told("今天天气很好", {}) == ("zho", 1.0) and language.told("Καλημέρα κόσμε", {}) == ("ell", 1.0) and language.told("привет", {}) == (None, 0.0)
    assert language.script_of("abc где") == "latin" and language.script_of("ab где") == "cyrillic"


def test_trigrams_of_expressions_and_of_the_detector_agree(spark):
    texts = ["Hello, World! 12", " a ", "", "éÀ ß-x", "x1y"]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string").orderBy("k").select(language.trigrams(F.col("s")).alias("t")).collect()]
    for text, grams in zip(texts, got, strict=True):
        plain = f" {language._OTHER.sub(' ', text.lower()).strip()} "
        assert [g for g in grams if g.strip()] == [g for g in (plain[k : k + 3] for k in range(len(plain) - 2)) if g.strip()]


def test_letters_and_trigrams_are_counted_in_arrays_as_one_by_one(spark):
    """Also beyond 16 bits; the documents' trigrams are counted before they become rows."""
    rng = random.Random(3)
    alphabet = "abcé İßñ² _7.ЖшΩあア漢한אกع𝒜𠮷\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(200)]
    for text in texts:
        plain = f" {language._OTHER.sub(' ', text.lower()).strip()} "
        assert [language._gram(c) for c in language._codes(plain).tolist()] == [plain[k : k + 3] for k in range(len(plain) - 2)]
        one_by_one = {name: len(re.findall(f"[{letters}]", text)) for name, letters in language.SCRIPTS.items()}
        best = max(one_by_one, key=one_by_one.get)
        kana = one_by_one["kana"] and one_by_one["kana"] + one_by_one["han"] > sum(one_by_one.values()) / 2
        assert language.script_of(text) == ("kana" if kana else best if one_by_one[best] else None)
    rows = [(t, "ab"[k % 2]) for k, t in enumerate(texts)] + [(None, "a"), ("abc", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    plain = df.where("lang is not null and text is not null").select("lang", language.plain_words(F.col("text")).alias("t")).collect()
    own = Counter((x.lang, x.t[k : k + 3]) for x in plain for k in range(len(x.t) - 2))
    ranked = {(lang, g, r) for lang in "ab" for r, (_, g) in enumerate(sorted((-n, g) for (x, g), n in own.items() if x == lang)[:300], 1)}
    out = language.profiles(df)
    assert {tuple(x) for x in out.collect()} == ranked and "Generate" not in out._jdf.queryExecution().executedPlan().toString()

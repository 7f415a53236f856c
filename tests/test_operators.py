"""Operators against literal folds on random rows, and every registered query against its SQL."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from parlance.operators import align, timing, words
from parlance.plans import catalog
from parlance.sources import chat

R = random.Random(5)


def test_alignment_is_complete_and_monotone():
    for _ in range(400):
        a, b = ([R.choice("abcde") for _ in range(R.randint(0, 70))] for _ in range(2))
        edits = align.align(a, b)
        p = [e["payload_idx"] for e in edits if e["payload_idx"] is not None]
        q = [e["reference_idx"] for e in edits if e["reference_idx"] is not None]
        assert p == list(range(len(a))) and q == list(range(len(b)))
        assert all(a[e["payload_idx"]] == b[e["reference_idx"]] for e in edits if e["op"] == "match")
        cost = align._last_row(a, b, lambda x, y: x == y)[-1]
        assert sum(e["op"] != "match" for e in edits) == cost
    assert all(e["op"] == "match" for e in align.align(list("same"), list("same")))


def test_character_alignment_takes_whole_texts(spark):
    d = __spark_entry__.SMOKE_DIR
    edits = {}
    for e in catalog.queries()["c2_character_alignment"](spark, d).collect():
        edits.setdefault(e.f, []).append(e)
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    assert edits.keys() == texts.keys()
    for f, text in texts.items():
        for side, want in (("payload_idx", text), ("reference_idx", text[2:])):
            assert "".join(e.key for e in sorted((e for e in edits[f] if e[side] is not None), key=lambda e: e[side])) == want
            assert sorted(e[side] for e in edits[f] if e[side] is not None) == list(range(len(want)))
        assert sum(e.op != "match" for e in edits[f]) == align._last_row(list(text), list(text[2:]), lambda x, y: x == y)[-1]


def test_jaro_winkler():
    assert abs(align.jaro_winkler("martha", "marhta") - 0.9611) < 1e-3 and align.jaro_winkler("", "a") == 0 and align.jaro_winkler("a", "a") == 1


def fold_retraced(w, least):
    out = [False] * len(w)
    for n in range(least, len(w) // 2 + 1):
        for b in range(len(w) - 2 * n + 1):
            if w[b : b + n] == w[b + n : b + 2 * n]:
                out[b : b + n] = [True] * n
    return out


@pytest.mark.parametrize("least", [1, 2])
def test_retraced(spark, least):
    rows = [(k, [R.choice("abc") for _ in range(R.randint(0, 14))]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, w array<string>")
    got = {r.k: r.r for r in df.select("k", words.retraced(df.w, least).alias("r")).collect()}
    assert got == {k: fold_retraced(w, least) for k, w in rows}


def test_monotonic(spark):
    rows = [(f, i, *((None, None) if R.random() < 0.3 else (s := R.randint(0, 99), s + 5))) for f in range(20) for i in range(15)]
    got = {(r.f, r.i): r.stripped for r in timing.monotonic(spark.createDataFrame(rows, "f long, i long, a long, b long")).collect()}
    for f in range(20):
        last = None
        for _, i, a, _ in sorted(r for r in rows if r[0] == f):
            back = a is not None and last is not None and a < last
            assert got[f, i] == back
            if a is not None and not back:
                last = a


def test_transcript_parse(spark):
    text = "@UTF8\n@Begin\n@Options:\tdummy, NoAlign\n@Participants:\tPAR Participant, INV Investigator\n*PAR:\thello there . \x15100_900\x15\n%mor:\tx|y .\n*INV:\t[- spa] +< hola\n\tamigo ?\n*CHI:\tno +...\nbroken\n@End\n"
    lines = chat.parse_lines(spark.createDataFrame([("f", text)], "file_id string, text string"))
    u = [tuple(r) for r in chat.utterances(lines).orderBy("utt_idx").collect()]
    assert u == [("f", 0, "PAR", None, "hello there", ".", 100, 900, False), ("f", 1, "INV", "spa", "hola amigo", "?", None, None, True), ("f", 2, "CHI", None, "no", "+...", None, None, False)]
    assert [r.value for r in lines.where("kind = 'error'").collect()] == ["broken"]
    assert [r.speaker for r in chat.undeclared_speakers(lines).collect()] == ["CHI"]
    assert tuple(chat.options(lines).first()) == ("f", True, True)
    with pytest.raises(Exception, match="not a transcript line"):
        chat.strict_lines(spark.createDataFrame([("f", text)], "file_id string, text string")).collect()


def test_whole_joins_equal_brute_force(spark):
    d = __spark_entry__.SMOKE_DIR
    utts = [r for r in catalog._read(spark, d, catalog.UTT).collect() if r.a is not None]
    got = sorted(tuple(r) for r in catalog.queries()["c7_overlap_join_whole"](spark, d).select("f", "win", "tok").collect())
    assert got == sorted((w.f, w.i, t.i) for w in utts for t in utts if t.f == w.f and t.a < w.b + 300 and t.b > w.a)
    assert {i for _, i, _ in got} >= {u.i for u in utts if u.b > u.a}
    segs = sorted(catalog._read(spark, d, catalog.SEG).collect(), key=lambda r: r.seg_idx)
    want = {}
    for u in utts:
        own = [s for s in segs if s.f == u.f]
        ended = [s for s in own if s.seg_end <= u.b]
        want[u.f, u.i] = (ended[-1] if ended else own[0]).speaker if own else None
    rows = catalog.queries()["c8_speaker_as_of_whole"](spark, d).collect()
    assert len(rows) == len(utts) and {(r.f, r.i): r.speaker for r in rows} == want


def test_groups_by_duration(spark):
    rows = [(1, k, a, b, w) for k, (a, b, w) in enumerate([(0, 10, 1), (10, 25, 2), (25, 40, 1), (5, 8, 0), (50, 60, 0)])]
    got = {r.i: r.grp for r in timing.group_by_duration(spark.createDataFrame(rows, "f long, i long, a long, b long, w long"), 30).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def value(x):
    if x is None or x != x:
        return "null"
    return str(round(float(x), 6)) if isinstance(x, float | int) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    d = __spark_entry__.SMOKE_DIR
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, d)
    assert sorted(got.columns) == sorted(names)
    table = sorted([value(r[c]) for c in sorted(names)] for r in got.collect())
    assert table == sorted([value(r[names.index(c)]) for c in sorted(names)] for r in want.fetchall())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_chinese_numbers():
    from parlance.operators.sequence import chinese_number

    want = {0: "零", 10: "十", 12: "十二", 20: "二十", 101: "一百零一", 110: "一百一十", 1005: "一千零五", 10000: "一万", 10005: "一万零五", 12345: "一万二千三百四十五", 100000: "十万", 100010001: "一亿零一万零一", 101234: "十万一千二百三十四"}
    assert {n: chinese_number(n) for n in want} == want


def test_sequences():
    from parlance.operators import sequence as q

    assert q.conform("It's") == ["it", "is"] and q.conform("gonna") == ["going", "to"] and q.conform("x-y") == ["x", "y"] and q.conform("eh") == ["um"]
    assert q.word_errors("aa bb cc".split(), "aa xx cc".split())["errors"] == 1 and q.word_errors([], ["a"])["wer"] == 1.0
    assert q.best_window(list("bcd"), list("aabcdaa")) == (2, 5)
    t = lambda *xs: [{"text": x, "time_s": k / 2} for k, x in enumerate(xs)]
    assert q.stitch(["hello", "there"], t("hel", "<|1|>", "lo", "there")) == [(0, 1500), (1500, 2000)] and q.stitch(["a", "b"], t("x", "b")) == [None, None]
    assert q.stitch(["a", "--"], t("a")) == [None, None] and q.stitch(["a", "b"], t("a", "b"), 100, False) == [(100, 100), (600, 600)]
    assert q.utterance_groups([[0, 1, 2], [3, 4, 5, 6]], 7) == [0, 0, 0, 1, 1, 1, 1] and q.utterance_groups([], 1) == [0]
    u = lambda t, s="A", m=0: {"text": t, "speaker": s, "timing": m}
    kinds = [x["kind"] for x in q.transcript_diff([u("a"), u("b"), u("c"), u("d")], [u("a", "B"), u("x"), u("c", m=1), u("e"), u("f")])]
    assert kinds.count("speaker_changed") == 1 and "timing_only" in kinds and "words_changed" in kinds


def test_compare_takes_every_gold_word(spark):
    from parlance.operators import sequence as q
    from parlance.plans import transcripts

    d = __spark_entry__.SMOKE_DIR
    got = {}
    for r in catalog.queries()["c5_compare"](spark, d).where("side = 'gold' and status != 'extra_main' and coalesce(tag, '') != 'PUNCT'").orderBy("f", "utt", "seq").collect():
        got.setdefault((r.f, r.utt), []).append(r.word.lower())
    want = {}
    for r in spark.read.parquet(f"{d}/benchmark.parquet").collect():
        gold = r.text.split()
        for u in range(0, len(gold), 10):
            kept = [w for w in gold[u : u + 10] if w not in words.PUNCTUATION and w.lower() not in words.FILLERS]
            want[r.item_id, u // 10] = [y.lower() for w in kept for y in q.conform(w)]
    assert max(u for _, u in want) > 1 and got == {k: v for k, v in want.items() if v}
    rows = spark.createDataFrame([(0, []), (1, ["a"] * 10), (2, list("abcdefghijk"))], "k int, w array<string>")
    assert [r.g for r in rows.select("k", transcripts.tens("w").alias("g")).orderBy("k").collect()] == [[], [["a"] * 10], [list("abcdefghij"), ["k"]]]


def utt(text, tags=None, end="."):
    return {"words": text.split(), "tags": tags, "terminator": end}


def test_compare_shows_both_sides():
    from parlance.operators import sequence as q

    got = q.compare([utt("the um dog ran", ["det", "x", "noun", "verb"]), utt("home now")], [utt("the cat ran"), utt("it's home")])
    shown = lambda side, u: [(r["word"], r["status"], r["place"]) for r in got if (r["side"], r["utt"]) == (side, u)]
    assert shown("gold", 0) == [("the", "match", 0.0), ("dog", "extra_main", 1.5), ("cat", "extra_gold", 1.0), ("ran", "match", 2.0), (".", "match", 3.0)][:1] + [("cat", "extra_gold", 1.0), ("dog", "extra_main", 1.5), ("ran", "match", 2.0), (".", "match", 3.0)]
    assert shown("main", 0) == [("the", "match", 0.0), ("cat", "extra_gold", 0.5), ("dog", "extra_main", 2.0), ("ran", "match", 3.0)]
    assert [r["tag"] for r in got if r["side"] == "main" and r["utt"] == 0] == ["DET", None, "NOUN", "VERB"]
    assert ("home", "match", 1.0) in shown("gold", 1) and ("it", "extra_gold", 0.0) in shown("gold", 1)


def test_alignment_as_the_golden_example():
    edits = align.align("i need cookie".split(), "i want cookie".split())
    assert [(e["op"], e["key"]) for e in edits] == [("match", "i"), ("extra_reference", "want"), ("extra_payload", "need"), ("match", "cookie")]
    assert align.align(["É"], ["é"], "caseless")[0]["op"] != "match" and align.align(["A"], ["a"], "caseless")[0]["op"] == "match"
    # Beyond the table the reference is halved; every index still comes once and in order, at the least cost.
    a, b = [R.choice("abcdefgh") for _ in range(300)], [R.choice("abcdefgh") for _ in range(280)]
    edits = align.align(a, b)
    assert [e["payload_idx"] for e in edits if e["payload_idx"] is not None] == list(range(300)) and sum(e["op"] != "match" for e in edits) == align._last_row(a, b, lambda x, y: x == y)[-1]


def recovered(u, speaker, text, span=None, lazy=False, bottoms=(), tops=()):
    return {"u": u, "speaker": speaker, "words": text.split(), "start_ms": span and span[0], "end_ms": span and span[1], "lazy": lazy, "bottoms": list(bottoms), "tops": [{"number": n, "fraction": f} for n, f in tops]}


def heard(*rows):
    return [{"text": t, "start_ms": a, "end_ms": b} for t, a, b in rows]


def test_two_pass_recovery():
    from parlance.operators import recovery as q

    utts = [recovered(0, "A", "well i went to the big store"), recovered(1, "B", "mhm", lazy=True), recovered(2, "A", "and then home"), recovered(3, "B", "okay")]
    tokens = heard(("well", 0, 300), ("i", 300, 400), ("went", 400, 800), ("mhm", 850, 900), ("to", 900, 1000), ("the", 1000, 1100), ("big", 1100, 1400), ("store", 1400, 1900), ("and", 2000, 2200), ("then", 2200, 2500), ("home", 2500, 3000), ("okay", 3100, 3300))
    assert q.two_passes(utts, tokens, q.TwoPass()) == [(0, 1900), (850, 900), (2000, 3000), (3100, 3300)]
    assert q.global_pass(utts, []) == [None] * 4 and q.global_pass([recovered(0, "A", "x", (5, 9))], tokens) == [(5, 9)]
    # An overlap far from its predecessor is found only in a wider window.
    late = [recovered(0, "A", "one two", (0, 1000)), recovered(1, "B", "yes", lazy=True), *[recovered(k, "A", f"w{k}") for k in range(2, 6)]]
    assert q.two_passes(late, heard(("yes", 2500, 2600)), q.TwoPass())[1] == (2500, 2600)
    assert q.two_passes(late, heard(("yes", 9000, 9100)), q.TwoPass())[1] is None
    marks = [recovered(0, "A", "a b c d", (0, 4000), tops=[(1, 0.25), (2, 0.75)]), recovered(1, "B", "x", bottoms=[2]), recovered(2, "B", "y", lazy=True)]
    timed = [True, False, False]
    assert [q.onset_fraction(k, marks, timed) for k in range(3)] == [None, 0.75, 0.25]
    assert q.unique_places(["a", "b"], ["A", "x", "b"]) == [0, 2] and q.unique_places(["a"], ["a", "a"]) is None and q.unique_places(["a"], []) is None and q.unique_places([], ["a"]) == []


def test_leases():
    from parlance.streaming.feed import lease_after

    none = (None, None, None)
    held = lease_after(none, "claim", "n1", 0.0, 10.0)
    assert held == ("n1", 0.0, 10.0) and lease_after(held, "claim", "n2", 5.0, 10.0) == held and lease_after(held, "claim", "n2", 10.0, 10.0) == ("n2", 10.0, 20.0)
    assert lease_after(held, "renew", "n1", 6.0, 10.0) == ("n1", 6.0, 16.0) and lease_after(held, "renew", "n2", 6.0, 10.0) == held
    assert lease_after(held, "release", "n2", 6.0, 10.0) == held and lease_after(held, "release", "n1", 6.0, 10.0) == none == lease_after(held, "terminal", "n9", 6.0, 10.0)


def test_lease_stream_equals_the_table(spark, tmp_path):
    from parlance.streaming import feed

    rows = [(j, k, R.choice(["claim", "renew", "release"]), R.choice(["n1", "n2"]), float(k)) for j in range(20) for k in range(15)]
    events = spark.createDataFrame(rows, "job_id long, event_id long, kind string, node string, at double")
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    got = {r.job_id: tuple(r)[1:] for r in feed.run_to_table(spark, feed.leases(stream, 10.0, expire=False), "leases", "update").collect()}
    assert got == {r.job_id: tuple(r)[1:] for r in feed.lease_table(events, 10.0).collect()}


def test_transcribe_command(spark):
    from parlance import commands

    said = "well um cuz. I I know，yes COVID-19 <noise> then"
    rows = [(1, k, w, k * 0.5, k * 0.5 + 0.4) for k, w in enumerate([*said.split(" "), "<pause>"])]
    got = commands.transcribe(spark.createDataFrame(rows, "f long, i long, value string, ts double, end_ts double"))
    text = [[r.word for r in sorted(g, key=lambda r: r.tok)] for _, g in itertools.groupby(sorted(got.collect(), key=lambda r: r.utt), key=lambda r: r.utt)]
    assert text == [["well", "&-um", "(be)cause", "."], ["I", "I", "know", ",", "yes", "COVID-19", "then", "."]]


def test_align_command(spark):
    from parlance import commands
    from parlance.operators import recovery

    utts = [(0, "A", ["a", "b"], None, None, False, [], []), (1, "B", ["c"], None, None, True, [], [])]
    files = spark.createDataFrame([(1, utts, [("a", 0, 100), ("b", 100, 200), ("c", 150, 180)])], f"f long, utterances {recovery.UTTERANCES}, tokens {recovery.TOKENS}")
    words_in = spark.createDataFrame([(1, 0, 0, 0, 50), (1, 0, 1, 120, 120), (1, 1, 0, 155, 160)], "f long, u int, i int, a long, b long")
    out = commands.align(files, words_in, total_ms=1000)
    assert sorted((r.u, r.start_ms, r.end_ms) for r in out["bullets"].collect()) == [(0, 0, 200), (1, 150, 180)]
    assert sorted((r.u, r.i, r.start_ms, r.end_ms) for r in out["words"].collect()) == [(0, 0, 0, 120), (0, 1, 120, 200), (1, 0, 155, 160)]
    assert out["groups"].count() == 2


def test_sources(spark, tmp_path):
    import struct

    from parlance.sources import files

    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "a.cha").write_text("@UTF8\n@Begin\n*PAR:\thello .\n@End\n")
    (tmp_path / "in" / "x" / "b.CHA").write_text("@Begin\n@Options:\tdummy\n@End\n")
    (tmp_path / "in" / "notes.txt").write_text("x")
    (tmp_path / "in" / "s.raw").write_bytes(struct.pack("<5f", 0.0, 0.5, -0.75, 0.25, 0.0))
    name = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    folder = str(tmp_path / "in")
    assert name(files.discovered(spark, folder, ["cha"])) == ["a.cha"] and sorted(name(files.copied(spark, folder, ["cha"], "align"))) == ["b.CHA", "notes.txt", "s.raw"]
    assert name(files.copied(spark, folder, ["cha"], "transcribe")) == ["b.CHA"]
    audio = files.read_audio(spark, f"{folder}/s.raw", 1000).first()
    assert (audio.n_samples, audio.duration_ms, audio.peak) == (5, 5, 0.75)
    assert files.base_folder(["/a/b/c.cha", "/a/d.cha"], lambda x: False) == "/a" and files.base_folder(["/q", "/a/d.cha"], lambda x: x == "/q") == "/q"
    chat.read_chat(spark, folder).count() == 1


def test_models_check_their_payload(spark):
    from parlance.functions import models

    models.register("utseg", lambda b: b, "trees array<string>")
    with pytest.raises(ValueError, match="lacks words"):
        models.infer(spark.createDataFrame([("x",)], "lang string"), "utseg")
    with pytest.raises(LookupError):
        models.infer(spark.range(1), "nothing")


def test_name_placeholders_and_diff():
    from parlance.operators import sequence as q

    r = q.word_errors("hello bob there".split(), "hello xname there".split())
    assert r["errors"] == 0 and r["matches"] == 3 and r["diff"] == "  hello\n+ xname\n  there"
    r = q.word_errors("dog cat".split(), "dog cow cat".split())
    assert (r["errors"], r["diff"]) == (1, "  dog\n+ cow\n  cat")


def test_numbers_letters_and_trees():
    from parlance.operators import sequence as q

    from parlance.plans.transcripts import ENGLISH

    # A value from a hundred on is said with its multiplier only from two on, and English has no word for zero in its table.
    say = lambda w, lang="eng": q.expanded_number(w, ENGLISH, lang)
    assert [say(str(n)) for n in (0, 7, 21, 100, 342, 1005, 2000000)] == ["0", "seven", "twenty one", "hundred", "three hundred forty two", "thousand five", "two million"]
    assert [say(w) for w in ("COVID-19", "21-22", "5—6", "$5", "5€", "€x", "a1", "")] == ["COVID-19", "twenty one twenty two", "five six", "five dollars", "five euros", "€x", "a1", ""]
    assert [say("42", "zho"), say("10000", "jpn"), say("$7", "yue")] == ["四十二", "一萬", "七 dollars"]
    assert q.merged_letters("the F B I A".split(), frozenset({"FBI", "FB"})) == ["the", "FBI", "A"] and q.merged_letters("f b i".split(), frozenset({"FBI"})) == ["fbi"]
    assert q.tree_ranges("(S (S (NP a) (VP b)) (CC and) (S (NP c) (VP d)))") == [[0, 1], [3, 4]]
    with pytest.raises(ValueError, match="open"):
        q.tree_ranges("(S (S a)")


def test_long_alignments_and_repeats_take_seconds(spark):
    import time

    r = random.Random(5)
    a = [str(r.randint(0, 2000)) for _ in range(10_000)]
    b = [x if r.random() < 0.8 else "q" for x in a if r.random() < 0.9]
    began = time.time()
    edits = align.align(a, b)
    assert time.time() - began < 10 and [e["payload_idx"] for e in edits if e["payload_idx"] is not None] == list(range(10_000))
    text = [str(k % 977) for k in range(100_000)]
    began = time.time()
    marks = words._marks(pd.Series([text, ["a", "a", "b"], None, []]), np.array([1, 1, 1, 1]))
    assert time.time() - began < 60 and marks[0].sum() == 100_000 - 977 and list(marks[1]) == [True, False, False] and marks[2] is None and len(marks[3]) == 0


def test_rows_of_alignments_equal_a_filled_table():
    r = random.Random(6)
    for _ in range(50):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 70))] for _ in range(2))
        near = lambda x, y: x == y or {x, y} == {"a", "b"}  # noqa: E731  no equivalence
        for same in (align.eq, near):
            row = list(range(len(b) + 1))
            for x in a:
                diagonal, row[0] = row[0], row[0] + 1
                for j, y in enumerate(b, 1):
                    diagonal, row[j] = row[j], min(diagonal + (0 if same(x, y) else 2), row[j] + 1, row[j - 1] + 1)
            assert align._last_row(a, b, same).tolist() == row

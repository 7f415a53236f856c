"""The content tree of main tiers: parsing, walks of every domain, and rebuilding over tokens."""

import gc

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from parlance.sources import content

# Main tiers with the words of each domain, written out by hand.
TIERS = [
    ("gonna [: going to] eat .", {"mor": "going to eat", "wor": "gonna eat", "pho": "gonna eat", "sin": "gonna eat", "fa": "going to eat"}),
    ("<I want> [/] I need cookie .", {"mor": "I need cookie", "wor": "I want I need cookie", "pho": "I want I need cookie", "sin": "I want I need cookie", "fa": "I want I need cookie"}),
    ("the [/] the dog .", {"mor": "the dog", "wor": "the the dog", "fa": "the the dog"}),
    ("<a <b c> [//] d> [/-] e ?", {"mor": "e", "wor": "a b c d e", "fa": "a b c d e"}),
    ("okay , xxx I'll put it „ no ‡ here .", {"mor": "okay , I'll put it „ no ‡ here", "wor": "okay I'll put it no here", "pho": "okay xxx I'll put it no here"}),
    ("&~uh &-um &+fr popcorn !", {"mor": "popcorn", "wor": "um popcorn", "pho": "uh um fr popcorn", "fa": "um popcorn"}),
    ("gumma@c is hola@s:spa yummy@s .", {"mor": "gumma is hola yummy", "wor": "gumma is hola yummy"}),
    ("&+fr [: friend] is 0gonna [: going to] xxx [: here] .", {"mor": "friend is going to here", "wor": "is", "pho": "fr is xxx", "fa": "friend is going to here"}),
    ("goed [: went] [* m] [e] away [e] <so far> [e] now .", {"mor": "now", "wor": "goed away so far now", "fa": "went away so far now"}),
    ("he ‹said it› 〔over there〕 “to me” .", {"mor": "he said it over there to me", "pho": "he over there to me", "sin": "he said it to me", "wor": "he said it over there to me"}),
    ("(be)cause ice+cream no:: butt⌈er⌉ (.) &=laughs 0 [=! cries] 0is it [?] \x15100_200\x15 +...", {"mor": "because icecream no butter it", "wor": "because icecream no butter it", "pho": "because icecream no butter is it"}),
    ("+< ⌈ yes ⌉ [>] [^ note] [+ bch] .", {"mor": "yes", "wor": "yes"}),
    ("+\" a ] > [/] <b", {"mor": "a b"}),
    ("", {d: "" for d in content.DOMAINS}),
    (None, {d: None for d in content.DOMAINS}),
]


@pytest.mark.parametrize("domain", content.DOMAINS)
def test_words_of_every_domain(spark, domain):
    rows = [(k, t) for k, (t, want) in enumerate(TIERS) if domain in want]
    got = spark.createDataFrame(rows, "k long, t string").select("k", content.domain_words(content.tree(F.col("t")), domain).alias("w")).collect()
    want = {k: None if TIERS[k][1][domain] is None else TIERS[k][1][domain].split() for k, _ in rows}
    assert {r.k: r.w for r in got} == want


def test_trees_name_parents_before_children_and_render_as_they_were():
    for text, _ in TIERS[:-3]:
        items = content.parse(text or "")
        assert content.render(items) == (text or "")
        nodes = content.flat(items)
        assert [n["id"] for n in nodes] == list(range(len(nodes)))
        for n in nodes:
            assert n["parent"] is None or n["parent"] < n["id"]
            up = [] if n["parent"] is None else [*nodes[n["parent"]]["within"], nodes[n["parent"]]["kind"]]
            assert [w for w in n["within"] if w != "excluded"] == [w for w in up if w != "excluded"]


def test_broken_tiers_keep_every_token():
    for text in ["a ] > [/] b", "[/] a", "> ] ‹ a", "a [: ", "<a [/] <b", "a [: ] b", "[: x] a", "〕 〔 a > b", "\x15 a"]:
        nodes = content.flat(content.parse(text))
        assert {"a"} <= {n["clean"] for n in nodes}
        assert content.flat(content.parse(content.render(content.parse(text)))) is not None


def test_deep_nesting_is_linear_in_text():
    nodes = content.flat(content.parse("<" * 150 + " a " + "> [/] " * 150))
    assert len(nodes) == 301 and nodes[-1]["clean"] == "a" and len(nodes[-1]["within"]) == 300


def test_words_know_category_form_and_language():
    one = lambda w: (lambda i: (i.clean, i.category, i.form, i.lang))(content.word_item(w))
    assert one("&-uh") == ("uh", "filler", None, None) and one("&+w") == ("w", "fragment", None, None) and one("&~gaga") == ("gaga", "nonword", None, None)
    assert one("gumma@c") == ("gumma", None, "c", None) and one("hola@s:spa+eng") == ("hola", None, None, "spa+eng") and one("ja@s") == ("ja", None, None, "")
    assert one("0det") == ("det", "omission", None, None) and one("XXX") == ("XXX", "untranscribed", None, None) and one("100_200")[1] == "timing"
    assert one("(a)bout") == ("about", None, None, None) and one("no::") == ("no", None, None, None) and one("ice+cream") == ("icecream", None, None, None)


# (main tier, tokens, rebuilt tier, tokens whose tags each word takes).
REBUILT = [
    ("I don't know .", ["I", "do", "n't", "know"], "I do n't know .", [[0], [1, 2], [3]]),
    ("hello world .", ["hello", "world"], "hello world .", [[0], [1]]),
    ("hello world .", ["hi", "world"], "hi world .", [[0], [1]]),
    ("<I want> [/] I don't need .", ["I", "do", "n't", "need"], "<I want> [/] I do n't need .", [[0], [1, 2], [3]]),
    ("呢 度 <下 次> [/] 下 次 食 飯 啦 .", ["呢度", "下次", "食飯", "啦"], "呢度 <下 次> [/] 下次 食飯 啦 .", [[0], [], [1], [], [2], [], [3]]),
    ("okay , I'll go .", ["okay", ",", "I", "'ll", "go"], "okay , I 'll go .", [[0], [1], [2, 3], [4]]),
    ("&~uh popcorn xxx !", ["popcorn"], "&~uh popcorn xxx !", [[0]]),
    ("<he don't> [% odd] go .", ["he", "do", "n't", "go"], "<he do n't> [% odd] go .", [[0], [1, 2], [3]]),
    ("dunno [* m] [?] now .", ["dun", "no", "now"], "dun [* m] [?] now .", [[0, 1], [2]]),
    ("gonna [: going tuh] [* x] eat .", ["going", "to", "eat"], "gonna [: going to] [* x] eat .", [[0], [1], [2]]),
    ("“gonna eat” .", ["gon", "na", "eat"], "“gon na eat” .", [[0, 1], [2]]),
    ("gumma@c is .", ["gumma", "is"], "gumma@c is .", [[0], [1]]),
    ("stop it", ["stop", "."], "stop it", [[0], [1]]),
    ("stop it [?]", ["stop", ","], "stop it [?]", [[0], [1]]),
]


def test_tiers_are_rebuilt_inside_groups_and_replacements(spark):
    rows = [(k, t, w) for k, (t, w, *_) in enumerate(REBUILT)]
    got = spark.createDataFrame(rows, "k long, t string, w array<string>").transform(content.retokenized, "t", "w").withColumnRenamed("rebuilt", "r")
    for r in got.collect():
        assert (r.r.text, [x.tokens for x in r.r.tags]) == REBUILT[r.k][2:], REBUILT[r.k]


def test_every_token_is_claimed_once_and_in_order(spark):
    rows = [(k, t, w) for k, (t, w, *_) in enumerate(REBUILT)]
    for r in spark.createDataFrame(rows, "k long, t string, w array<string>").transform(content.retokenized, "t", "w").withColumnRenamed("rebuilt", "r").collect():
        assert [t for x in r.r.tags for t in x.tokens] == list(range(len(r.w)))


def test_commands_take_replacements_and_leave_retraces_out(spark):
    from parlance import commands

    text = "@Begin\n*CHI:\tgonna [: going to] eat . \x15100_900\x15\n*MOT:\t<I want> [/] I &-um want , it [e] ?\n@End\n"
    got = commands.parsed(spark.createDataFrame([("a", text)], "file_id string, text string")).orderBy("u").collect()
    assert [r.words for r in got] == [["going", "to", "eat"], ["I", "want", ","]] and [r.terminator for r in got] == [".", "?"]


@pytest.mark.parametrize("name", ["b1_domain_sin", "b1_domain_wor", "b1_domain_fa"])
def test_walks_hold_the_trees_of_few_texts_at_once(spark, monkeypatch, tmp_path, name):
    """Of a batch with thousands of turns no more trees are objects at any time than a part has rows, and every turn has its words."""
    import duckdb

    real, calls = content.flat, []

    def counted(items):
        calls.append(None)
        if len(calls) % 1000 == 0:
            alive = sum(type(x) is dict and "within" in x and x.get("id") == 0 for x in gc.get_objects())
            assert alive <= 256, f"{alive} trees after {len(calls)} texts"
        return real(items)

    monkeypatch.setattr(content, "flat", counted)
    rows = spark.range(0, 4000, 1, 1).selectExpr("id div 8 as conv_id", "id % 8 as turn", "'user' as role", "array_join(transform(sequence(1, id % 11), k -> substr('abcdefghijk', 1, k)), ' ') as text")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall()) and len(got) == 4000

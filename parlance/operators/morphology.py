"""Tagged sentences as morphology and grammar tiers, token realignment and retokenization.

A sentence is one row with an array of words, so everything here is an expression over
that row's arrays: nothing is exploded, shuffled or gathered.  A word is a struct with
``id`` and ``id_end`` (the last id of a range of component words, else null), ``decimal``
(an empty node, which has no place in the tiers), ``text``, ``lemma``, ``upos``, ``feats``
(``A=x|B=y``), ``head`` and ``deprel``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from parlance.operators.words import features_map, gra_relation, let, mor_safe

WORD = "struct<id:int,id_end:int,decimal:boolean,text:string,lemma:string,upos:string,feats:string,head:int,deprel:string>"
TAG_MARKS = (",", "„", "‡")
# Terminators that a retokenized sentence does not take over, as it has its own.
TERMINATORS = (".", "?", "!", "+...", "+/.", "+//.", "+/?", "+//?", "+..?", '+".', '+"/.')

# English verbs with their irregular past forms and participles.
IRREGULAR = """
abide: abode; arise: arose, arisen; awake: awoke, awoken; bade: bidden; be: was, were, been; bear: bore, borne; beat: beat, beaten; become: became, become; befall: befell, befallen;
beget: begot, begotten; begin: began, begun; behold: beheld, beholden; bend: bent; bereave: bereft; beseek: besought; bet: bet; betake: betook, betaken; bid: bid; bind: bound;
bite: bit, bitten; bleed: bled; blow: blew, blown; break: broke, broken; breed: bred; bring: brought; build: built; burn: burnt; burst: burst; buy: bought; cast: cast; catch: caught;
choose: chose, chosen; clad: clad; cleave: cleft, cloven; cling: clung; come: came, come; cost: cost; creep: crept; cut: cut; deal: dealt; dig: dug; dive: dove, dived; do: did, done;
draw: drew, drawn; dream: dreamt; drink: drank, drunk; drive: drove, driven; dwell: dwelt; eat: ate, eaten; fall: fell, fallen; feed: fed; feel: felt; fight: fought; find: found; fit: fit;
flee: fled; fling: flung; fly: flew, flown; forbid: forbade, forbidden; forecast: forecast; foresee: foresaw, foreseen; foretell: foretold; forget: forgot, forgotten; forgive: forgave, forgiven;
forgo: forewent, foregone; forsake: forsook, forsaken; forswear: forswore, forsworn; freeze: froze, frozen; get: got, gotten; gild: gilt; give: gave, given; go: went, gone; grind: ground;
grow: grew, grown; hang: hung; have: had; hear: heard; hew: hewn; hide: hid, hidden; hit: hit; hold: held; hurt: hurt; inlay: inlaid; input: input; inset: inset; interlay: interlaid;
interweave: interwoven; keep: kept; kneel: knelt; knit: knit; know: knew, known; lay: laid; lead: led; leap: leapt; leave: left; led: led; lend: lent; let: let; lie: lay, lain; lose: lost;
make: made; mean: meant; meet: met; misspeak: misspoke, mispoken; mistake: mistook, mistaken; offset: offset; outbid: outbid; overdo: overdid, overdone; partake: partook, partaken; pay: paid;
plead: pled; prepay: prepaid; prove: proven; put: put; quit: quit; read: read; recast: recast; redo: redid, redone; remake: remade; rend: rent; reset: reset; rid: rid, ridden; ride: rode, ridden;
ring: rang, rung; rise: rose, risen; run: ran, run; say: said; see: saw, seen; seek: sought; sell: sold; send: sent; set: set; sew: sewn; shake: shook, shaken; shave: shaven; shed: shed;
shine: shone; shoot: shot; show: shown; shrink: shrank, shrunk; shut: shut; sing: sang, sung; sink: sank, sunk; sit: sat; slay: slew, slain; sleep: slept; slide: slid; slink: slunk; slit: slit;
smite: smote, smitten; sneak: snuck; speak: spoke, spoken; speed: sped; spend: spent; spin: spun; spit: spit; split: split; spread: spread; spring: sprang, sprung; stand: stood; steal: stole, stolen;
stick: stuck; sting: stung; stink: stank, stunk; strew: strewn; strike: struck; string: strung; strive: strove, striven; swear: swore, sworn; sweep: swept; swell: swollen; swim: swam, swum;
swing: swung; take: took, taken; teach: taught; tear: tore, torn; tell: told; think: thought; throw: threw, thrown; thrust: thrust; tread: trod; unbend: unbended, unbent; undergo: underwent, undergone;
underlie: underlay, underlain; understand: understood; upset: upset; wake: woke, woken; waylay: waylaid; wear: wore, worn; weave: wove, woven; wed: wed; weep: wept; wet: wet; win: won; wind: wound;
withdraw: withdrew, withdrawn; withhold: withheld; withstand: withstood; wreak: wrought, wrough; wring: wrung; write: wrote, written
"""
_IRREGULAR = [f"{lemma.strip()} {form.strip()}" for entry in IRREGULAR.split(";") for lemma, _, forms in [entry.partition(":")] for form in forms.split(",")]

# French nouns in -al whose plural sounds different, -aux but where another is given.
AUDIBLE_PLURALS = """
amiral animal annal anormal anticlérical arsenal bocal canal cantal capital caporal cardinal central chenal cheval clérical collatéral colonial commensal communal confessionnal cordial corporal cristal
cérébral fanal frontal fédéral féodal gardénal général hôpital idéal international journal libéral local madrigal marsupial maréchal mal minéral moral méridional métal nasal national normal numéral
occidental occipital oral ordinal oriental original piédestal principal provincial quintal radical rival rural régional sentimental signal social sénéchal temporal tergal total tribunal urinal vassal
val végétal véronal:véronals éditorial égal étal:étau
"""
_AUDIBLE = [form for entry in AUDIBLE_PLURALS.split() for one, _, other in [entry.partition(":")] for form in (one, other or one[:-1] + "ux")]
# French pronouns by case.
NOMINATIVE = "qui je tu il elle ils elles moi toi lui eux".split()
ACCUSATIVE = "que quoi me te le la les lui leur".split()
# Words that lean on a neighbour, by language; an ending stands behind ``*``.
CLITICS = {"en": ("n't", "'s", "'ve", "'ll"), "fr": ("*'", "-ce", "-être", "-là"), "it": ("*'",)}

# Japanese forms in the order in which they are tried: what the text or lemma
# holds (``text``, ``lemma``) or is (``text=``, ``lemma=``), a tag it must have, and the tag and lemma it gets.
JAPANESE = (
    ("text", "ちゃ", "", "sconj", "ば"), ("text", "なきゃ", "", "sconj", "なきゃ"), ("text", "じゃ", "", "sconj", "ちゃ"), ("text", "れる", "", "aux", "られる"), ("text", "じゃう", "", "aux", "ちゃう"),
    ("text", "よう", "", "aux", "おう"), ("text", "だら", "", "aux", "たら"), ("lemma", "だ", "", "aux", "た"), ("lemma&text=", "為る さ", "", "part", "為る"), ("lemma", "無い", "", "aux", "ない"),
    ("lemma", "せる", "", "aux", "させる"), ("text", "撮る", "", "verb", "撮る"), ("text", "貼る", "", "verb", "貼る"), ("text", "混ぜ", "", "verb", "混ぜる"), ("text", "釣る", "", "verb", "釣る"),
    ("text", "速い", "adj", "adj", "速い"), ("text", "治ま", "", "verb", "治まる"), ("text", "刺す", "", "verb", "刺す"), ("text", "降り", "", "verb", "降りる"), ("text", "降", "", "verb", "降る"),
    ("text", "載せ", "", "verb", "載せる"), ("text", "帰", "", "verb", "帰る"), ("text", "はい", "", "intj", "はい"), ("text", "うん", "", "intj", "うん"), ("text", "おっ", "", "intj", "おっ"),
    ("text", "ほら", "", "intj", "ほら"), ("text", "ヤッホー", "", "intj", "ヤッホー"), ("text", "ただいま", "", "intj", "ただいま"), ("text", "あたし", "", "pron", "あたし"), ("text", "舐め", "", "verb", "舐める"),
    ("text", "バツ", "", "noun", "バツ"), ("text", "ブラシ", "", "noun", "ブラシ"), ("text", "引き出し", "", "noun", "引き出し"), ("text", "下さい", "", "noun", "下さい"), ("lemma=", "シャャミー", "", "noun", "クシャミ"),
    ("lemma=", "物コャミ", "", "noun", "クシャミ"), ("text", "マヨネーズ", "", "noun", "マヨネーズ"), ("text", "マヨ", "", "noun", "マヨ"), ("text", "チップス", "", "noun", "チップス"),
    ("text", "ゴロンっ", "", "noun", "ゴロンっ"), ("text", "モチーンっ", "", "noun", "モチーンっ"), ("text=", "人っ", "", "noun", "人"), ("text=", "掻く", "", "part", "かい"), ("text", "遣", "noun", "verb", "遣る"),
    ("text", "死", "", "verb", "死ぬ"), ("text", "立", "", "verb", "立つ"), ("text", "引", "", "verb", "引く"), ("text", "出", "", "verb", "出す"), ("text", "飲", "", "verb", "飲む"), ("text", "呼", "", "verb", "呼ぶ"),
    ("text", "脱", "", "verb", "脱ぐ"), ("text=", "な", "part", "aux", "な"),
)


def _has(c: Column, s: str) -> Column:
    return F.contains(c, F.lit(s))


def clean_lemma(lemma: Column, text: Column) -> Column:
    """A lemma fit for a stem; the text where nothing of it is left."""

    def or_text(value: Column, test: Callable[[Column], Column], instead: Column = text) -> Column:
        return let(value, lambda t: F.when(test(t), instead).otherwise(t))

    t = or_text(F.coalesce(lemma, F.lit("")), lambda t: F.trim(t).isin("」", "「") | t.isin('"', ""))
    t = or_text(F.translate(t, "」「", ""), lambda t: F.startswith(t, F.lit("0")) & (F.octet_length(t) > 1) & (F.octet_length(text) > 1), F.substring(text, 2, 1 << 30))
    t = F.translate(or_text(t, lambda t: _has(t, "<SOS>")), "$.", "")
    t = F.regexp_replace(F.regexp_replace(t, "(?s)^-(?=.)", ""), r"(?s)(?<=.)-\z", "")
    for old, new in (("--", "-"), ("--", "-"), ("<unk>", ""), ("<SOS>", ""), ("/100", ""), ("/r", "")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(F.translate(t, ",'~()", ""), r"(?s)\s*\|.*\z", "")
    t = or_text(F.translate(t, "_+", ""), lambda t: t == "door zogen")
    t = or_text(F.replace(t, F.lit("-"), F.lit("–")), lambda t: _has(t, "“"))
    t = F.trim(F.regexp_replace(t, r"@[\p{L}\p{N}_]\z", ""))
    return let(t, lambda t: F.when(t != "", t).when(text != "", text).otherwise("x"))


def is_irregular(lemma: Column, form: Column) -> Column:
    """Whether an English form is an irregular one of its verb."""
    return F.concat_ws(" ", F.lower(lemma), F.lower(form)).isin(*_IRREGULAR)


def french_pronoun_case(text: Column) -> Column:
    """``Nom``, ``Acc`` or null for a French pronoun."""
    bare = F.trim(F.btrim(F.lower(text), F.lit("'")))
    return F.when(bare.isin(*NOMINATIVE), "Nom").when(bare.isin(*ACCUSATIVE), "Acc")


def has_audible_plural(text: Column) -> Column:
    """Whether a French noun's plural sounds different."""
    return F.lower(F.trim(text)).isin(*_AUDIBLE)


def japanese_form(tag: Column, lemma: Column, text: Column) -> Column:
    """(tag, lemma) that a Japanese form gets instead of its own; null where none applies."""
    out: Column | None = None
    for where, mark, need, new_tag, new_lemma in JAPANESE:
        if where == "lemma&text=":
            held, exact = mark.split()
            test = _has(lemma, held) & (text == exact)
        elif where.endswith("="):
            test = (text if where == "text=" else lemma) == mark
        else:
            test = _has(text if where == "text" else lemma, mark)
        test = test & (tag == need) if need else test
        made = F.struct(F.lit(new_tag).alias("tag"), F.lit(new_lemma).alias("lemma"))
        out = F.when(test, made) if out is None else out.when(test, made)
    return out


def two_letters(lang: Column) -> Column:
    """A language's code of two letters, for the languages with rules of their own."""
    return F.when(F.length(lang) == 2, lang).when(lang == "eng", "en").when(lang == "fra", "fr").when(lang == "jpn", "ja").when(lang == "ita", "it").when(lang == "por", "pt").when(lang == "nld", "nl").otherwise(lang)


def _person(f: Column, default: str) -> Column:
    p = F.coalesce(f["Person"], F.lit(default))
    return F.when(p == "0", "4").otherwise(p)


def suffixes(upos: Column, tag: Column, f: Column, text: Column, lemma: Column, deprel: Column, lang: Column) -> Column:
    """The feature suffixes of a word, an array without empty ones; ``f`` is the map of its features."""
    get = lambda k: f[k]
    first = lambda c: F.substring(c, 1, 1)
    plural = F.when(F.startswith(get("Number"), F.lit("P")), "P").otherwise("S")
    past = F.when((lang == "en") & (get("Tense") == "Past") & is_irregular(lemma, text), "irr")
    verb = F.array(
        F.coalesce(get("VerbForm"), F.lit("Inf")), *map(get, ("Aspect", "Mood", "Tense", "Polarity", "Polite")), F.lower(get("HebBinyan")), F.lower(get("HebExistential")),
        F.concat(F.coalesce(F.nullif(first(get("Number")), F.lit("")), F.lit("S")), _person(f, "")), past,
    )
    is_verb = _has(tag, "verb") | _has(tag, "aux")
    verb = F.when(_has(tag, "sconj") | (text == "ろ"), F.array().cast("array<string>")).when(is_verb, verb).when(text == "たり", F.array(F.lit("Inf"), F.lit("S"))).otherwise(F.array().cast("array<string>"))
    pron = F.array(
        F.coalesce(get("PronType"), F.lit("Int")), F.when(lang == "fr", french_pronoun_case(text)).otherwise(get("Case")), F.when(get("Reflex") == "Yes", "reflx"),
        F.when(~text.isin("that", "who"), F.concat(plural, _person(f, "1"))),
    )
    number = F.coalesce(get("Number"), F.lit(""))
    gender = F.coalesce(get("Gender"), F.when((lang == "fr") & (number != "Plur"), "Masc"))
    owner = F.concat(F.coalesce(first(get("Number[psor]")), F.lit("")), F.coalesce(get("Person[psor]"), F.lit("")))
    det = F.array(F.when(~gender.isin("Com,Neut", "Com"), gender), F.coalesce(get("Definite"), F.lit("Def")), get("PronType"), number, owner)
    adj = F.array(F.when(get("Degree") != "Pos", get("Degree")), get("Case"), F.concat(F.coalesce(F.nullif(first(get("Number")), F.lit("")), F.lit("S")), _person(f, "1")))
    noun = F.array(
        F.when(~get("Gender").isin("Com,Neut", "Com"), get("Gender")), F.when(get("Number") != "Sing", get("Number")), F.coalesce(get("Case"), F.when(deprel == "obj", "Acc")), get("PronType"),
        F.when((lang == "en") & F.endswith(text, F.lit("ing")), "Ger"), F.when((lang == "fr") & (number == "Plur") & has_audible_plural(text), "Apm"),
    )
    picked = F.when(upos.isin("VERB", "AUX"), verb).when(upos == "PRON", pron).when(upos == "DET", det).when(upos == "ADJ", adj).when(upos.isin("NOUN", "PROPN"), noun).otherwise(F.array().cast("array<string>"))
    return F.filter(picked, lambda x: x.isNotNull() & (x != ""))


def mor_word(w: Column, lang: Column) -> Column:
    """H18 for one word: ``tag|stem-suffixes``; null where no stem is left.  ``lang`` has two letters."""
    text, lemma, upos = w["text"], F.coalesce(w["lemma"], F.lit("")), F.upper(w["upos"])
    plain = F.when(upos.isin("SYM", "X") | upos.isNull(), "x").when(F.rlike(upos, F.lit("^[A-Z]+$")), F.lower(upos)).otherwise("punct")
    comma = (lang == "ja") & ((upos == "PUNCT") | lemma.isin("、", ","))

    def tagged(x: Column) -> Column:
        """The tag and stem of a word (tag, lemma), and of those its item."""
        form = F.when(lang == "ja", japanese_form(x["tag"], x["lemma"], text))
        named = F.struct(F.when(comma, "cm").otherwise(F.coalesce(form["tag"], x["tag"])).alias("tag"), mor_safe(F.coalesce(form["lemma"], x["lemma"])).alias("stem"), features_map(w["feats"]).alias("f"))
        made = lambda y: F.concat(y["tag"], F.lit("|"), F.array_join(F.concat(F.array(y["stem"]), suffixes(upos, y["tag"], y["f"], text, lemma, w["deprel"], lang)), "-"))
        return let(named, lambda y: F.when(y["stem"] != "", made(y)))

    item = let(F.struct(plain.alias("tag"), clean_lemma(lemma, text).alias("lemma")), tagged)
    return F.when(lemma.isin(",", "$,"), "cm|cm").when(lemma.isin(".", "!", "?"), F.concat(F.lit("punct|"), lemma)).otherwise(item)


def is_clitic(text: Column, lang: Column) -> Column:
    """Whether a component of a word leans on its neighbour."""
    tests = [(lang == k) & (F.endswith(text, F.lit(v[1:])) if v.startswith("*") else text == v) for k, vs in CLITICS.items() for v in vs]
    return reduce(lambda a, b: a | b, tests)


def graph_problem(heads: Column) -> Column:
    """What is wrong with a grammar tier's heads (counted from 1; 0 or itself is a root); null if nothing is.

    The last item is the terminator, whose head may be 0.  Cycles are found by pointer
    doubling: after as many rounds as the length has bits every head has gone to a root,
    or it never will.
    """

    def judged(h: Column) -> Column:
        n = F.size(h)
        roots = F.size(F.filter(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), lambda x, k: (x == 0) | (x == k + 1)))
        # Item 0 is where roots, and heads that are not there, lead to and stay.
        up = F.concat(F.array(F.lit(0)), F.transform(h, lambda x, k: F.when((x == k + 1) | (x < 0) | (x > n), 0).otherwise(x)))
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
        far = F.aggregate(rounds, up, lambda acc, _: F.transform(acc, lambda x: F.get(acc, x)))
        found = F.when(roots == 0, "no root").when(roots > 1, "roots").when(F.exists(far, lambda x: x != 0), "cycle").when(F.exists(h, lambda x: (x < 0) | (x > n)), "missing head")
        return F.when(n > 0, found)

    return let(heads, judged)


def tagged_sentence(words: Column, lang: Column) -> Column:
    """(mor, gra, problem) of a tagged sentence: its items, its relations ``index|head|NAME``, or what is wrong with it.

    Component words of a range become one item, the first that is no clitic before the
    others, and count one by one in the relations.  The terminator's relation comes last.
    """


    def tagged(ws: Column) -> Column:
        ranges = F.filter(F.transform(ws, lambda w, k: F.struct(k.alias("k"), (w["id_end"] - w["id"] + 1).alias("n"))), lambda r: r["n"].isNotNull())
        return let(two_letters(lang), lambda two: let(ranges, lambda rs: let(_parts(ws, rs, two), lambda ps: _tiers(ws, rs, ps))))

    return let(words, tagged)  # bound, as it is used inside functions of each word


def _parts(words: Column, ranges: Column, lang: Column) -> Column:
    """Words that have a place in the tiers, with their item: its first place, and how many parts it has."""
    placed = F.filter(F.transform(words, lambda w, k: F.struct(k.alias("k"), w.alias("w"))), lambda p: p["w"]["id_end"].isNull() & ~F.coalesce(p["w"]["decimal"], F.lit(False)))

    def part(p: Column) -> Column:
        over = F.filter(ranges, lambda r: (r["k"] < p["k"]) & (p["k"] <= r["k"] + r["n"]))
        own = F.struct(p["k"].alias("k"), F.lit(1).alias("n"))
        return F.struct(F.coalesce(F.get(over, F.size(over) - 1), own).alias("item"), p["w"].alias("w"), mor_word(p["w"], lang).alias("mor"), is_clitic(p["w"]["text"], lang).alias("clitic"))

    return F.transform(placed, part)


def _tiers(words: Column, ranges: Column, parts: Column) -> Column:
    def item(own: Column) -> Column:
        main = F.coalesce(F.array_position(F.transform(own, lambda p: p["clitic"]), False), F.lit(0))
        main = F.greatest(main, F.lit(1)).cast("int")
        rest = F.concat(F.slice(own, 1, main - 1), F.slice(own, main + 1, F.size(own)))
        return F.array_join(F.transform(F.concat(F.slice(own, main, 1), rest), lambda p: p["mor"]), "~")

    def made(x: Column) -> Column:
        items = F.transform(F.array_distinct(x["items"]), lambda i: let(F.slice(parts, F.array_position(x["items"], i).cast("int"), i["n"]), item))
        place = lambda h: F.when(h == 0, 0).otherwise(F.nullif(F.array_position(x["ids"], h), F.lit(0).cast("long")).cast("int"))
        root = F.array_max(F.filter(F.transform(parts, lambda p, k: F.when(p["w"]["head"] == 0, k + 1)), lambda k: k.isNotNull()))
        return F.struct(
            items.alias("mor"), F.transform(parts, lambda p: place(p["w"]["head"])).alias("heads"), F.transform(parts, lambda p: gra_relation(p["w"]["deprel"])).alias("names"), F.coalesce(root, F.lit(0)).alias("root")
        )

    def judged(t: Column) -> Column:
        n = F.size(parts)
        broken = F.exists(ranges, lambda r: r["k"] + r["n"] >= F.size(words))
        problem = (
            F.when(broken, "range").when(F.exists(parts, lambda p: p["mor"].isNull()), "empty stem").when(F.exists(t["heads"], lambda h: h.isNull()), "missing head").when(F.exists(t["names"], lambda r: r.isNull()), "relation")
            .when((n > 0) & (t["root"] == 0), "no root").otherwise(graph_problem(F.concat(t["heads"], F.array(t["root"]))))
        )
        gra = F.transform(F.arrays_zip(t["heads"].alias("h"), t["names"].alias("r")), lambda x, k: F.concat_ws("|", (k + 1).cast("string"), x["h"].cast("string"), x["r"]))
        gra = F.concat(gra, F.array(F.concat_ws("|", (n + 1).cast("string"), t["root"].cast("string"), F.lit("PUNCT"))))
        return let(problem, lambda p: F.struct(F.when(p.isNull(), t["mor"]).alias("mor"), F.when(p.isNull(), gra).alias("gra"), p.alias("problem")))

    index = F.struct(F.transform(parts, lambda p: p["w"]["id"]).alias("ids"), F.transform(parts, lambda p: p["item"]).alias("items"))
    return let(let(index, made), judged)


# --- tokens --------------------------------------------------------------------------

TOKEN = "struct<text:string,hint:boolean>"


def _token(text: Column, hint: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.lit(None).cast("boolean") if hint is None else hint).alias("hint"))


def is_contraction(text: Column, lang: Column) -> Column:
    """Whether an English token is a contraction; ``o'clock`` and the like are none."""
    return (lang == "en") & _has(text, "'") & (F.lower(F.trim(F.substring_index(text, "'", 1))) != "o")


def _patched(t: Column, lang: Column) -> Column:
    """The tokens that one token becomes by its language's rules."""
    low, text = F.lower(t["text"]), t["text"]
    force, keep = F.lit(True), F.lit(False)
    parts = F.filter(F.regexp_extract_all(text, F.lit("([^']*'|[^']+$)"), 1), lambda p: p != "")
    split = F.transform(parts, lambda p: _token(p, keep))
    cut = F.instr(text, "'")
    elision = F.filter(F.array(F.substring(text, F.lit(1), cut), F.substring(text, cut + 1, F.length(text))), lambda p: p != "")
    fr = (
        F.when(low == "aujourd'hui", F.array(_token(F.lit("aujourd'hui")))).when(low == "au", F.array(_token(text, force))).when(F.length(text) - F.length(F.replace(text, F.lit("'"), F.lit(""))) >= 2, split)
        .when(_has(text, "'") & F.lower(F.substring_index(text, "'", 1)).isin("jusqu", "puisqu", "quelqu", "aujourd"), F.transform(elision, lambda p: _token(p, keep)))
    )
    it = F.when((low == "l'") & F.coalesce(t["hint"], keep), F.array(_token(text, keep)))
    pt = F.when(low == "d'água", F.array(_token(text, force)))
    nl = F.when(F.endswith(low, F.lit("'s")), F.array(_token(text, keep)))
    return F.coalesce(F.when(lang == "fr", fr).when(lang == "it", it).when(lang == "pt", pt).when(lang == "nl", nl), F.array(t))


def overridden(tokens: Column, lang: Column) -> Column:
    """Tokens (text, hint) after the rules for French, Italian, Portuguese and Dutch.

    ``hint`` says whether a token is to be expanded into words; null leaves it open.  Italian
    ``le`` and ``i`` side by side are one word that was cut.
    """
    none = F.array().cast(f"array<{TOKEN}>")

    def step(acc: Column, t: Column) -> Column:
        joins = (lang == "it") & (F.lower(t["text"]) == "i") & (F.lower(F.get(acc, F.size(acc) - 1)["text"]) == "le")
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(_token(F.lit("lei"))))).otherwise(F.concat(acc, _patched(t, lang)))

    return F.aggregate(tokens, none, step)


def _spans(xs: Column) -> Column:
    """Strings of an array with where they start and end (s, e) in all of them joined, and their place ``k``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<t:string,s:int,e:int,k:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("t"), acc["at"].alias("s"), end.alias("e"), F.size(acc["out"]).alias("k")))).alias("out"))

    return F.aggregate(xs, start, step, lambda acc: acc["out"])


def realigned(words: Column, tokens: Column, lang: Column) -> Column:
    """Tokens (text, hint) merged back to the words that they spell; unchanged where they spell something else.

    Parentheses of shortened words are left out first.  A token over two words goes to the first.
    """
    bare = F.transform(words, lambda w: F.translate(w, "()", ""))
    plain = F.transform(tokens, lambda t: _token(t))

    def aligned(x: Column) -> Column:
        ws, ts, two = x["w"], x["t"], x["lang"]
        one_each = F.forall(ws, lambda w: F.size(F.filter(ts, lambda t: (t["e"] > w["s"]) & (t["s"] < w["e"]))) == 1)
        groups = F.filter(F.transform(ws, lambda w: F.transform(F.filter(ts, lambda t: (t["s"] >= w["s"]) & (t["s"] < w["e"]) & (t["e"] > t["s"])), lambda t: t["t"])), lambda g: F.size(g) > 0)
        merged = F.transform(groups, lambda g: F.when(F.size(g) == 1, _token(F.get(g, 0))).otherwise(let(F.array_join(g, ""), lambda m: _token(m, is_contraction(m, two)))))
        blank = F.transform(F.filter(tokens, lambda t: t == ""), lambda t: _token(t))
        return overridden(F.when(one_each, plain).otherwise(F.concat(merged, blank)), two)

    spelled = (F.size(words) > 0) & (F.size(tokens) > 0) & (F.array_join(bare, "") == F.array_join(tokens, ""))
    made = let(F.struct(_spans(bare).alias("w"), _spans(tokens).alias("t"), two_letters(lang).alias("lang")), aligned)
    return F.when(F.coalesce(spelled, F.lit(False)), made).otherwise(plain)


def token_places(words: Column, tokens: Column) -> Column:
    """C16 and C17 in one row: for each word the places of its tokens, by shared characters, or by length where the spellings differ."""
    low = lambda xs: F.transform(xs, lambda x: F.lower(x))
    n, m = F.size(words), F.size(tokens)

    def exact(x: Column) -> Column:
        return F.transform(x["w"], lambda w: F.transform(F.filter(x["t"], lambda t: (t["e"] > w["s"]) & (t["s"] < w["e"])), lambda t: t["k"]))

    same = (F.lower(F.array_join(words, "")) == F.lower(F.array_join(tokens, ""))) & ~F.exists(words, lambda x: x == "") & ~F.exists(tokens, lambda x: x == "")
    start = lambda k: F.floor(k * m / n).cast("int")
    by_length = F.transform(words, lambda _, k: F.sequence(start(k), F.greatest(start(k + 1), F.least(start(k) + 1, m)) - 1))
    none = F.transform(words, lambda _: F.array().cast("array<int>"))
    return F.when((n == 0) | (m == 0), none).when(same, let(F.struct(_spans(low(words)).alias("w"), _spans(low(tokens)).alias("t")), exact)).otherwise(by_length)


def retokenized(items: Column, tokens: Column) -> Column:
    """A sentence's items (text, kind) rebuilt over new tokens, with ``tags``, how many tags each takes up.

    Items of kind ``word`` become their tokens: one that is the same word stays, a token that
    several words share is written once, and one that is no word (a terminator) ends its word,
    which is then kept.  An ``annotated`` word stays one item and takes its first token.
    ``mark`` (a separator that has a tag of its own) and ``other`` (which has none) stay.
    """
    alignable = F.filter(items, lambda x: x["kind"] != "other")
    places = token_places(F.transform(alignable, lambda x: x["text"]), tokens)
    # An item's number among those that count, -1 for others.
    counted = F.aggregate(
        items, F.array().cast("array<struct<text:string,kind:string,n:int,upto:int>>"),
        lambda acc, x: F.concat(acc, F.array(let(F.coalesce(F.get(acc, F.size(acc) - 1)["upto"], F.lit(0)) + F.when(x["kind"] == "other", 0).otherwise(1), lambda c: F.struct(x["text"].alias("text"), x["kind"].alias("kind"), F.when(x["kind"] == "other", -1).otherwise(c - 1).alias("n"), c.alias("upto"))))),
    )
    is_end = lambda t: t.isin(*TERMINATORS) | (F.trim(t) == "")

    def rebuilt(ps: Column) -> Column:
        def one(x: Column) -> Column:
            own = F.when(x["n"] >= 0, F.get(ps, x["n"])).otherwise(F.array().cast("array<int>"))
            before = F.get(ps, F.greatest(x["n"] - 1, F.lit(-1)))  # places rise, so the item before has the largest of those so far
            earlier = F.when(x["n"] > 0, F.array_max(before))
            text = F.transform(own, lambda t: F.get(tokens, t))
            made = lambda t, k, n: F.struct(t.alias("text"), k.alias("kind"), n.cast("int").alias("tags"))
            keep = lambda n: F.array(made(x["text"], x["kind"], n))
            shared = F.coalesce(F.array_max(own) <= earlier, F.lit(False)) & (F.size(own) > 0)
            end = F.size(F.filter(F.transform(text, lambda _, k: ~F.exists(F.slice(text, 1, k + 1), is_end)), lambda ok: ok))  # tokens before the first that is no word
            kind = lambda t: F.when(t.isin(*TAG_MARKS), "mark").otherwise("word")
            words = F.transform(F.slice(text, 1, end), lambda t: made(t, kind(t), F.lit(1)))
            word = F.when(F.size(own) == 0, keep(F.lit(1))).when(shared, F.slice(keep(F.lit(0)), 1, 0)).when((F.size(own) == 1) & (F.get(text, 0) == x["text"]), keep(F.lit(1)))
            word = word.when(end < F.size(text), F.concat(words, keep(F.size(text) - end))).otherwise(words)
            first = F.get(text, 0)
            inner = F.when((F.size(own) == 0) | shared | is_end(first) | first.isin(*TAG_MARKS), x["text"]).otherwise(first)
            annotated = F.array(made(inner, x["kind"], F.when(shared, 0).when(F.size(own) == 0, 1).otherwise(F.size(own))))
            return F.when(x["kind"] == "word", word).when(x["kind"] == "annotated", annotated).when(x["kind"] == "mark", keep(F.lit(1))).otherwise(keep(F.lit(0)))

        return F.flatten(F.transform(counted, one))

    return let(places, rebuilt)

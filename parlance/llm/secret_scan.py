"""Secret scans through a trigram inverted index.

A Boolean query over trigrams is derived from each rule's regular expression.  Documents are
dealt into blocks by a hash, and the index holds, for each block and each trigram that some
query names, the postings: the hashes of the block's documents that have it.  A query is
answered block by block by intersecting and uniting postings, and only the documents it
leaves are verified with the expression itself; their hashes are joined to the texts by
broadcast while they are few.  A rule without mandatory trigrams (``hex``) reads every text.
Everything runs as built-in expressions.

Results for odd input: a null text counts as empty and an empty text has no spans; the
digest is then that of the empty string.  Spans count code points with the end exclusive.
Documents are known by a hash of id and text, so rows that repeat both share a posting, null
ids are ids like others, and a clash of hashes only widens the candidates: each row is
verified by itself.  Other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parlance.llm._common import cut, table, text_of

#: Kinds in the order in which ties are listed: (kind, expression, least length of group 2 or 0).
#: The first three are the base; expressions are read alike by Java, RE2 and Python.  None repeats a
#: group, as Java's matcher takes stack for each round of one; it repeats classes in a loop.
RULES: list[tuple[str, str, int]] = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0),
    ("hex", r"[0-9a-f]{32,}", 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("google", r"AIza[A-Za-z0-9_-]{35,}", 0),
    ("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0),
]
BASE = 3
#: Documents that a block of the index holds, about; candidates up to which their hashes are broadcast (some 40 MB).
BLOCK_DOCS, BROADCAST_DOCS = 8192, 500_000
_MARK = "\x01"
#: Sets of exact strings larger than this are turned into trigrams before they grow further.
_EXACT_LIMIT = 16


# Queries are None (always true), ("gram", g), ("and", [...]) or ("or", [...]).
def _all(parts: list) -> object:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list) -> object:
    return None if any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]) -> object:
    """What must hold if one of the strings occurs."""
    return _any([_all([("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(tokens) -> tuple[list, set[str]]:
    """Queries already certain, and the strings that may end here since the last break."""
    certain: list = []
    exact: set[str] = {""}

    def brk() -> None:
        nonlocal exact
        certain.append(_of_strings(exact))
        exact = {""}

    for op, arg in tokens:
        choices: set[str] | None = None
        if op is sre.LITERAL:
            choices = {chr(arg).lower()}
        elif op is sre.IN and arg[0][0] is not sre.NEGATE and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= _EXACT_LIMIT:
            choices = {chr(v).lower() for _, v in arg}
        elif op is sre.SUBPATTERN:
            more, choices = _exact(arg[3])
            certain += more
        elif op is sre.BRANCH:
            branches = [_exact(b) for b in arg[1]]
            if all(not more and s is not None for more, s in branches):
                choices = set().union(*(s for _, s in branches))
            else:
                certain.append(_any([_all([*more, _of_strings(s or {""})]) for more, s in branches]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            more, s = _exact(body)
            if low == 0 and high == 1 and not more and s is not None:
                choices = s | {""}
            elif low == 1 and high == 1:
                certain += more
                choices = s
            elif low >= 1:
                certain += more
                certain.append(_of_strings(s) if s is not None else None)
        if choices is None:
            brk()
        else:
            if len(exact) * len(choices) > _EXACT_LIMIT:
                certain.append(_of_strings(exact))
                exact = {x[-2:] for x in exact}
            exact = {a + b for a, b in itertools.product(exact, choices)}
    return certain, exact


def _exact(tokens) -> tuple[list, set[str] | None]:
    """As ``_walk``; the strings are None if the tokens can match others as well."""
    open_ended = any(
        op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and not arg[1] == 1 or op is sre.IN and (arg[0][0] is sre.NEGATE or any(k is not sre.LITERAL for k, _ in arg)) or op in (sre.ANY, sre.CATEGORY, sre.NOT_LITERAL)
        for op, arg in tokens
    )
    certain, exact = _walk(tokens)
    if open_ended:
        return [*certain, _of_strings(exact)], None
    return certain, exact


def trigram_query(pattern: str) -> object:
    """A Boolean query over trigrams of the lower-cased text that holds wherever ``pattern`` matches."""
    certain, exact = _walk(sre_parser.parse(pattern))
    return _all([*certain, _of_strings(exact)])


def grams_of(query: object) -> set[str]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1]))


def _answer(query: object, postings: Column, place: dict[str, int]) -> Column:
    """The documents of a block that satisfy a query, from a map of its postings."""
    if query[0] == "gram":
        return F.coalesce(postings[F.lit(place[query[1]])], F.array().cast("array<bigint>"))
    parts = [_answer(q, postings, place) for q in query[1]]
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, parts)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, key): the text, never null, and a hash of both."""
    return docs.select("doc_id", text_of().alias("text"), F.xxhash64("doc_id", "text").alias("key"))


def index(docs: DataFrame, grams: list[str], blocks: int) -> DataFrame:
    """The index: rows (block, gram, docs) of keyed documents, ``gram`` being its place in ``grams``."""
    there = F.array(*[F.when(F.contains("lower", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)])
    found = docs.select("key", F.lower("text").alias("lower")).select("key", F.explode(there).alias("gram")).where("gram is not null")
    return found.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.collect_set("key").alias("docs"))


def candidates(docs: DataFrame, rules: list[tuple[str, str, int]] = RULES) -> DataFrame:
    """Rows (key, rules): the rules whose queries a keyed document's postings satisfy."""
    asked = {kind: q for kind, p, _ in rules if (q := trigram_query(p)) is not None}
    grams = sorted(set().union(*map(grams_of, asked.values())))
    place = {g: k for k, g in enumerate(grams)}
    blocks = max(64, docs.count() // BLOCK_DOCS)
    postings = index(docs, grams, blocks).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "docs"))).alias("postings"))

    def named(kind: str) -> Callable[[Column], Column]:
        return lambda d: F.struct(d.alias("key"), F.lit(kind).alias("rule"))

    met = F.flatten(F.array(*[F.transform(_answer(q, F.col("postings"), place), named(kind)) for kind, q in asked.items()]))
    return postings.select(F.explode(met).alias("m")).groupBy("m.key").agg(F.collect_set("m.rule").alias("rules"))


def spans(text: Column, k: int, rules: list[tuple[str, str, int]] = RULES) -> Column:
    """Array of (start, k, end), in order, of rule ``k``'s matches that pass."""
    _, pattern, least = rules[k]
    pieces = F.split(F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit("\x02")), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK)
    empty = F.array().cast("array<struct<start:int,k:int,end:int>>")

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        hit = acc["odd"] & (F.length(F.regexp_extract(piece, pattern, 1)) >= least) if least else acc["odd"]
        one = F.array(F.struct(acc["at"].alias("start"), F.lit(k).alias("k"), end.alias("end")))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(hit, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), empty.alias("out"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def secret_scan(docs: DataFrame, rules: list[tuple[str, str, int]] = RULES) -> DataFrame:
    """Rows (doc_id, text, found): ``found`` is a sorted array of (start, kind's place, end)."""
    free = {kind for kind, p, _ in rules if trigram_query(p) is None}
    rows = keyed(docs)
    few = cut(candidates(rows, rules))
    marked = rows.join(F.broadcast(few) if few.count() <= BROADCAST_DOCS else few, "key", "left")
    empty = F.array().cast("array<struct<start:int,k:int,end:int>>")
    each = []
    for k, (kind, pattern, _) in enumerate(rules):
        asked = F.rlike(F.col("text"), F.lit(pattern)) if kind in free else F.coalesce(F.array_contains("rules", kind), F.lit(False))
        each.append(F.when(asked, spans(F.col("text"), k, rules)).otherwise(empty))
    return marked.select("doc_id", "text", F.sort_array(F.concat(*each)).alias("found"))


def _joined(found: Column, rules: list[tuple[str, str, int]] = RULES) -> Column:
    names = F.array(*[F.lit(kind) for kind, _, _ in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    # An outer explode of one element keeps the spans from being made anew for each column.
    out = out.select("doc_id", F.explode_outer(F.array("found")).alias("found"))
    count = lambda k: F.size(F.filter("found", lambda s: s["k"] == k)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("found", lambda s: s["k"] < BASE)), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def _sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    cut = ", ".join(f"string_split(regexp_replace(t, {quote(p)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p{k}" for k, (_, p, _) in enumerate(RULES))
    lists = ", ".join(
        f"[{{'s': coalesce(list_sum([length(y) for y in p{k}[1:2 * i - 1]]), 0)::BIGINT, 'k': {k}, 'e': coalesce(list_sum([length(y) for y in p{k}[1:2 * i]]), 0)::BIGINT}}"
        f" for i in range(1, len(p{k}) // 2 + 1)" + (f" if length(regexp_extract(p{k}[2 * i], {quote(p)}, 1)) >= {least}" if least else "") + f"] AS l{k}"
        for k, (_, p, least) in enumerate(RULES)
    )
    names = "[" + ", ".join(f"'{kind}'" for kind, _, _ in RULES) + "]"
    line = lambda which: f"array_to_string([{names}[z.k + 1] || ':' || z.s || ':' || z.e for z in list_sort({which})], ',')"
    base, every = ("list_concat(" * (n - 1) + "l0" + "".join(f", l{k})" for k in range(1, n)) for n in (BASE, len(RULES)))
    return f"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
cut AS (SELECT doc_id, {cut} FROM d), found AS (SELECT doc_id, {lists} FROM cut)
SELECT doc_id, len(l0)::BIGINT AS n_assign, len(l1)::BIGINT AS n_access, len(l2)::BIGINT AS n_hex,
  sha256(coalesce({line(base)}, '')) AS base_sha256, coalesce({line(every)}, '') AS spans FROM found"""


OP3_SQL = _sql()

"""Queries of content trees (A1, B1, H28), with their SQL.

Main tiers are written from the words of the conversations by nine rules in turn, so that the SQL
can state what a tier's tree, its words in each domain and its rebuilt form must be without
reading the tier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.plans.catalog import D_TURN, TURN, _read, query
from parlance.sources import content

#: For the rule of each word ``w``: the text, and the nodes as (kind, letters, steps up to the parent).
RULES = (
    ("w", (("word", "w", 0),)),
    ("concat(w, ' [: fix ', w, ']')", (("replaced", "w", 0), ("word", "'fix'", 1), ("word", "w", 2))),
    ("concat('<', w, ' ', w, '> [/]')", (("retrace", "''", 0), ("group", "''", 1), ("word", "w", 1), ("word", "w", 2))),
    ("concat('&-', w)", (("word", "w", 0),)),
    ("'xxx'", (("word", "'xxx'", 0),)),
    ("concat(w, ' [e]')", (("word", "w", 0),)),
    ("concat('‹', w, ' ', w, '›')", (("pho_group", "''", 0), ("word", "w", 1), ("word", "w", 2))),
    ("concat(w, ' ,')", (("word", "w", 0), ("separator", "','", 0))),
    ("concat('&+', w, ' [: ', w, ']')", (("replaced", "w", 0), ("word", "w", 1))),
)
#: The words of each rule in each domain.
WORDS = {
    "mor": ("[w]", "['fix', w]", "[]", "[]", "[]", "[]", "[w, w]", "[w, ',']", "[w]"),
    "wor": ("[w]", "[w]", "[w, w]", "[w]", "[]", "[w]", "[w, w]", "[w]", "[]"),
    "pho": ("[w]", "[w]", "[w, w]", "[w]", "['xxx']", "[w]", "[]", "[w]", "[w]"),
    "sin": ("[w]", "[w]", "[w, w]", "[w]", "['xxx']", "[w]", "[w, w]", "[w]", "[w]"),
    "fa": ("[w]", "['fix', w]", "[w, w]", "[w]", "[]", "[w]", "[w, w]", "[w]", "[w]"),
}
#: A word's tokens in the rebuilt tiers: two letters and the rest, where it has four or more; and the first of them.
_TOKENS, _FIRST = "CASE WHEN length(w) > 3 THEN concat(substr(w, 1, 2), ' ', substr(w, 3)) ELSE w END", "CASE WHEN length(w) > 3 THEN substr(w, 1, 2) ELSE w END"
REBUILT = (
    _TOKENS, f"concat(w, ' [: fix ', {_FIRST}, ']')", RULES[2][0], RULES[3][0], RULES[4][0], RULES[5][0],
    f"concat('‹', {_TOKENS}, ' ', {_TOKENS}, '›')", f"concat({_TOKENS}, ' ,')", f"concat('&+', w, ' [: ', {_FIRST}, ']')",
)

_D_PLAIN = f"SELECT f, u, list_filter(ws, lambda w: regexp_matches(w, '^[A-Za-z]+$') AND lower(w) NOT IN ('xxx', 'yyy', 'www')) AS ws FROM ({D_TURN}) t"


def _of(cases: tuple[str, ...]) -> str:
    return f"CASE (k + u) % {len(cases)} " + " ".join(f"WHEN {c} THEN {x}" for c, x in enumerate(cases)) + " END"


def _each(cases: tuple[str, ...]) -> str:
    """DuckDB's list over the words ``w`` of a turn and their places ``k``."""
    return f"[{_of(cases)} FOR w, k0 IN ws]".replace("(k + u)", "(k0 - 1 + u)")


def _tiers(s: SparkSession, d: str) -> DataFrame:
    plain = _read(s, d, TURN).selectExpr("f", "u", "filter(split(trim(text), '\\\\s+'), w -> w rlike '^[A-Za-z]+$' and lower(w) not in ('xxx', 'yyy', 'www')) as ws")
    return plain.selectExpr("f", "u", "ws", f"concat(array_join(transform(ws, (w, k) -> {_of(tuple(t for t, _ in RULES))}), ' '), ' .') as text")


_NODES = tuple("[" + ", ".join(f"{{'kind': '{kind}', 'clean': {w}, 'up': {up}}}" for kind, w, up in nodes) + "]" for _, nodes in RULES)
query(
    "a1_content_tree",
    f"""WITH n AS (SELECT f, u, list_concat(flatten({_each(_NODES)}), [{{'kind': 'terminator', 'clean': '', 'up': 0}}]) AS ns FROM ({_D_PLAIN}) p),
    x AS (SELECT f, u, unnest(ns) AS n, unnest(range(len(ns))) AS id FROM n)
    SELECT f, u, id::INTEGER AS id, n.kind AS kind, n.clean AS clean, CASE WHEN n.up > 0 THEN id - n.up END::INTEGER AS parent FROM x""",
)(lambda s, d: _tiers(s, d).select("f", "u", F.explode(content.tree(F.col("text"))).alias("n")).select("f", "u", "n.id", "n.kind", "n.clean", "n.parent"))

for _domain, _words in WORDS.items():
    query(f"b1_domain_{_domain}", f"SELECT f, u, array_to_string(flatten({_each(_words)}), ' ') AS words FROM ({_D_PLAIN}) p")(
        lambda s, d, domain=_domain: _tiers(s, d).select("f", "u", F.array_join(content.domain_words(content.tree(F.col("text")), domain), " ").alias("words"))
    )

_N_TOKENS = _each(tuple(f"list_sum([CASE WHEN length(x) > 3 THEN 2 ELSE 1 END FOR x IN {w}::VARCHAR[]])" for w in WORDS["mor"]))


@query(
    "h28_rebuilt_tiers",
    f"SELECT f, u, array_to_string(list_append({_each(REBUILT)}, '.'), ' ') AS text, coalesce(list_sum({_N_TOKENS}), 0)::BIGINT AS tags FROM ({_D_PLAIN}) p",
)
def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    # A tokenizer's answer: the words of the tier, long ones in two.
    spelled = F.explode_outer(F.array(content.domain_words(content.tree(F.col("text")), "mor")))
    cut = F.flatten(F.transform("w", lambda w: F.when(F.length(w) > 3, F.array(F.substring(w, 1, 2), F.substring(w, F.lit(3), F.length(w)))).otherwise(F.array(w))))
    out = content.retokenized(_tiers(s, d).withColumn("w", spelled).withColumn("tokens", cut))
    return out.select("f", "u", "rebuilt.text", F.aggregate("rebuilt.tags", F.lit(0).cast("long"), lambda a, x: a + F.size(x["tokens"])).alias("tags"))

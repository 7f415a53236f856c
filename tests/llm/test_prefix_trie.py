"""The trie against one built turn by turn in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from parlance.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, k long, key string, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)


def literal(rows, families=True):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}

    def whole(c):
        if not families:
            return own[c]
        h = zlib.crc32(str(c).encode()) % 6
        return own.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])[:h] + own[c][h:]

    members = defaultdict(list)
    for c in own:
        turns = whole(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, d == len(turns)))
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids[node]]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        sums[node] = (leaves, saved)
        ends = ",".join(map(str, sorted(c for c, last in members[node] if last)))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in members[node]), len(node), parent, len(members[node]), len(kids[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(nodes):
    return sorted((tuple(r) for r in nodes.select(*COLUMNS).collect()), key=repr)


def random_rows(seed, n, depth, kinds):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]) if kinds > 1 else "user", r.choice("abcdefgh"[:kinds]) * r.randint(1, 1 if kinds < 4 else 3)) for c in range(n) for t in range(r.randint(1, depth))]


ODD = [
    (0, 0, "user", "hello"), (0, 1, "assistant", "hi"), (0, 1, "assistant", "also"), (0, None, None, None), (1, 5, "user", "é\U0001F600"), (1, 5, "user", "é\U0001F600"), (2, 0, "user", None), (3, 0, "", ""),
    (None, 0, "user", "nobody"), (250, 3, "user", "without a first"), (201, 0, "user", "short"), (-7, 0, "user", "hello"), (-100, 0, "user", "hello"), (-100, 1, "user", "more"), (2**40, 0, "use", "rhello"), (2**40 + 1, 0, "user", "hello"),
]


@pytest.mark.parametrize("rows", [ODD, random_rows(1, 250, 9, 2), random_rows(2, 120, 14, 1), random_rows(3, 300, 6, 8), [(c, t, "user", f"t{t}") for c in (3, 5, 8) for t in range(700)] + random_rows(4, 30, 5, 2)])
def test_nodes_equal_a_trie_in_memory(spark, rows):
    assert found(pt.trie(*pt.rebuilt(pt.numbered(table(spark, rows))))) == literal(rows)


def test_conversations_as_they_are_with_texts(spark):
    rows = random_rows(7, 60, 7, 3) + [(100, t, "user", "x" * (t % 3)) for t in range(300)]
    nodes = pt.conversation_trie(table(spark, rows))
    assert found(nodes) == literal(rows, families=False)
    turns = {(c, t + 1): (r, x) for c, t, r, x in rows}
    assert all((r.role, r.text) == turns.get((r.conv_id, r.depth), (None, None)) for r in nodes.collect())


def test_hot_beginnings_and_hot_conversations_take_the_other_join(spark, monkeypatch):
    import parlance.llm._common as common

    monkeypatch.setattr(common, "HOT_LEAST", 3)
    monkeypatch.setattr(pt, "IDS", 2)
    rows = random_rows(9, 200, 6, 2)
    assert found(pt.trie(*pt.rebuilt(pt.numbered(table(spark, rows))))) == literal(rows)


def test_only_turnless_conversations_and_empty_table(spark):
    lone = [c for c in range(1, 400) if c % 100 and zlib.crc32(str(c).encode()) % 6 > 2][:3]
    rows = [(c, t, "user", "x") for c in lone for t in range(2)]
    got = found(pt.trie(*pt.rebuilt(pt.numbered(table(spark, rows)))))
    assert got == literal(rows) and len(got) == 1
    assert pt.trie(*pt.rebuilt(pt.numbered(table(spark, []).limit(0)))).count() == 0

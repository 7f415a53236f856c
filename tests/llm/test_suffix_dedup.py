"""Suffix arrays against sorted suffixes, and repeated strings against a table of all of them."""

import hashlib
import random

import numpy as np
import pytest

from parlance.llm import suffix_dedup as sd

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def literal(rows):
    """{row: (n_bytes, n_removed, n_spans, kept)} by the smallest id of every 50-byte string."""
    data = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 49) if i is not None else ():
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(docs):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.suffix_dedup(docs).collect()], key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 50, 51, 52, 400])
@pytest.mark.parametrize("kinds", [1, 2, 3, 250])
def test_suffix_array_equals_sorted_suffixes(n, kinds):
    s = np.random.default_rng(n).integers(1, kinds + 1, n)
    assert sd.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_suffix_array_with_names_too_wide_to_pack():
    s = np.random.default_rng(1).choice([1, 2**40, 2**40 + 1], 300)
    ranks = np.unique(s, return_inverse=True)[1] + 1
    order, new = sd._sorted_triples(s[:-2], s[1:-1], s[2:])
    want = sorted(range(298), key=lambda i: tuple(s[i : i + 3]))
    assert [tuple(s[i : i + 3]) for i in order] == [tuple(s[i : i + 3]) for i in want]
    assert new.sum() == len({tuple(s[i : i + 3]) for i in range(298)}) and sd.suffix_array(ranks).tolist() == sorted(range(300), key=lambda i: ranks[i:].tolist())


SHARED = prose(40, 1)
TEXTS = [
    (0, None), (1, ""), (2, "short"), (3, "x" * 49), (4, "x" * 50), (5, "x" * 300), (6, "y" + "x" * 120 + "z"), (7, prose(200, 2)), (8, prose(200, 2)), (9, prose(50, 3) + SHARED + prose(50, 4)),
    (10, SHARED), (11, prose(20, 5) + SHARED[:60] + prose(20, 6) + SHARED[30:150] + SHARED), (12, "é語\U0001F600" * 30), (13, "a" + "é語\U0001F600" * 25), (14, prose(300, 7)[100:]), (15, prose(300, 7)),
    (-3, SHARED[10:90]), (20, SHARED[:49]), (21, SHARED[:50]), (22, "ab" * 200), (23, "ba" * 90), (24, "\x00" * 60), (25, "\x00" * 70), (2**40, prose(20, 5)), (26, SHARED[:100] + SHARED[:100]),
]
SCHEMA = "doc_id long, text string, tag int, lo int, gid long, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "k") for i, t in rows], SCHEMA)


def test_repeats_equal_a_table_of_all_strings(spark):
    assert found(table(spark, TEXTS)) == literal(TEXTS)


def test_null_ids_repeated_rows_and_ids_of_several_texts(spark):
    rows = [*TEXTS, (None, SHARED), (None, SHARED + "!"), (10, SHARED), (10, "other " + SHARED + prose(30, 7)), (7, prose(60, 3)), (16, prose(60, 3)), (16, "q" + prose(60, 3))]
    assert found(table(spark, rows)) == literal(rows)


def test_random_copies_with_all_routes(spark, monkeypatch):
    r = random.Random(5)
    pool = [prose(r.randint(5, 60), 100 + k) for k in range(12)]
    rows = [(k, prose(r.randint(0, 6), 900 + k % 50) + " ".join(r.choice(pool)[r.randint(0, 9) :] for _ in range(r.randint(0, 4)))) for k in range(300)]
    want = literal(rows)
    assert found(table(spark, rows)) == want
    monkeypatch.setattr(sd, "WIDE", 2)  # bytes of nearly all anchors are compared window by window
    assert found(table(spark, rows)) == want
    monkeypatch.setattr(sd, "HOT_LEAST", 1 << 40)  # no anchor is hot
    monkeypatch.setattr(sd, "PIECE", 64)  # texts are cut into pieces
    assert found(table(spark, rows)) == want
    monkeypatch.setattr(sd, "HELD", 2000)
    monkeypatch.setattr(sd, "WIDE", 20_000)
    assert found(table(spark, rows)) == want


def test_kept_bytes_and_empty_table(spark):
    kept = {r.doc_id: bytes(r.kept) for r in sd.suffix_dedup(table(spark, [(1, "abc " + SHARED), (2, "head " + SHARED + " tail")])).collect()}
    assert kept == {1: ("abc " + SHARED).encode(), 2: b"head tail"}
    assert sd.suffix_dedup(table(spark, []).limit(0)).count() == 0

"""Fill-in-the-middle against literal slicing, and the boundary set against sorted arrays."""

import hashlib
import re

import numpy as np
import pytest

from parlance.llm import fill_middle as fm

ODD = [None, "", "\n", "one", "a\nb", "a\nb\n", "\n\n\n", "é\n語\U0001F600\nx", "has <M> inside\nx", "a<\n<S\nb>\n", "\x00\n\r\nb", "line\n" * 70_000, "x" * 200_000 + "\ny", "".join("y\n" if k % 3 else "abc\n" for k in range(90_000))]
SCHEMA = "doc_id long, text string, n long, form string, cut1 long, h3 long"


def literal(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("values", [
    np.arange(0), np.array([0]), np.array([65535, 65536]), np.arange(5, 200_000), np.arange(0, 400_000, 3), np.arange(0, 10_000_000, 70_001),
    np.unique(np.random.default_rng(1).integers(0, 1 << 20, 60_000)), np.append(np.arange(10), np.arange(1 << 21, (1 << 21) + 50_000, 2)),
])
def test_boundary_set_selects_every_rank(values):
    found = fm.BoundarySet(values)
    assert len(found) == len(values)
    ranks = range(0, len(values), max(1, len(values) // 997))
    assert [found.select(k) for k in ranks] == values[list(ranks)].tolist()


def test_each_kind_of_container_is_taken():
    kinds = lambda v: [type(c) for c in fm.BoundarySet(np.asarray(v)).containers]
    assert kinds([1, 9, 77]) == [fm.ArrayContainer]
    assert kinds(range(0, 40_000, 2)) == [fm.BitmapContainer]
    assert kinds(range(60_000)) == [fm.RunContainer]
    assert kinds([*range(60_000), 70_000, 70_005]) == [fm.RunContainer, fm.ArrayContainer]


def test_forms_and_texts_equal_literal_slicing(spark):
    rows = [(k, t, 9, "f", 8, 7) for k, t in enumerate(ODD * 3)] + [(None, "a\nb\nc", 1, "f", 1, 1), (4, ODD[4], 9, "f", 8, 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = fm.fill_in_middle(docs)
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()]
    key = lambda r: (r[0] is None, r[0], r[5])
    assert sorted(got, key=key) == sorted(((i, *literal(i, t)) for i, t, *_ in rows), key=key)
    back = out.select("doc_id", fm.restored(out.form, out.output).alias("text")).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted(map(tuple, back), key=key) == sorted(((i, t or "") for i, t, *_ in rows), key=key)


def test_shares_of_forms_and_empty_table(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'a\nb\nc\nd' as text")
    count = {r.form: r["count"] for r in fm.fill_in_middle(docs, fim_percent=60, spm_percent=25).groupBy("form").count().collect()}
    assert abs(count["plain"] - 800) < 100 and abs(count["spm"] - 300) < 80
    assert fm.fill_in_middle(docs.limit(0)).count() == 0

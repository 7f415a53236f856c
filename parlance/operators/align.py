"""Order-preserving alignment of word sequences, and what is counted over it."""

from __future__ import annotations

from collections.abc import Callable
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

EDITS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("key", T.StringType()), T.StructField("payload_idx", T.IntegerType()), T.StructField("reference_idx", T.IntegerType())]))
#: Cells up to which one table is filled; larger problems are halved.
TABLE_CELLS = 2048


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two strings, 1 for equal ones."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def _fold(word: str) -> bytes:
    """A word with ASCII capitals, and no others, made small."""
    return word.encode("utf-8", "surrogatepass").lower()


def _prepared(payload: list[str], reference: list[str], mode: str, threshold: float) -> tuple[list, list, Callable]:
    """Both sequences as what is compared, and how."""
    if mode == "exact":
        return payload, reference, eq
    if mode == "caseless":
        return [_fold(w) for w in payload], [_fold(w) for w in reference], eq
    known: dict[tuple[str, str], bool] = {}

    def near(x: str, y: str) -> bool:
        if (x, y) not in known:
            known[x, y] = known[y, x] = _fold(x) == _fold(y) or jaro_winkler(x.lower(), y.lower()) >= threshold
        return known[x, y]

    return payload, reference, near


def _masks(b: list, same: Callable) -> Callable[[object], int]:
    """For a word, the places of ``b`` that match it, as the bits of an integer."""
    places: dict[object, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    if same is eq:
        return lambda x: places.get(x, 0)
    known: dict[object, int] = {}

    def mask(x: object) -> int:
        if x not in known:
            known[x] = sum(bits for y, bits in places.items() if same(x, y))
        return known[x]

    return mask


def _last_row(a: list, b: list, same: Callable) -> np.ndarray:
    """What it costs to align all of ``a`` with each beginning of ``b``.

    A substitution costs as much as two gaps, so that is the number of words less twice those of a longest common
    subsequence.  One row of its table is one integer, whose zero bits are the places where the length grows, and a row
    follows from the one before by an addition and a few Boolean operations on whole integers.
    """
    n, mask = len(b), _masks(b, same)
    row = full = (1 << n) - 1
    for x in a:
        hits = row & mask(x)
        row = ((row + hits) | (row - hits)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), dtype=np.uint8), count=n, bitorder="little")
    common = np.append(0, np.cumsum(1 - bits.astype(np.int64)))
    return len(a) + np.arange(n + 1) - 2 * common


def _steps(a: list, b: list, same: Callable) -> list[tuple[str, int, int]]:
    """Edits of payload a over reference b as (op, i, j); gaps cost 1, a substitution 2, so that it is a pair of gaps.

    Equal ends are matched first.  What is between is aligned by one table if it is small;
    otherwise the reference is halved, and the payload where that costs least, first of ties.
    """
    head = 0
    while head < min(len(a), len(b)) and same(a[head], b[head]):
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and same(a[-1 - tail], b[-1 - tail]):
        tail += 1
    middle: list[tuple[str, int, int]] = []
    todo = [(head, len(a) - tail, head, len(b) - tail)]
    while todo:
        i, m, j, n = todo.pop()
        if i == m or j == n:
            middle += [("extra_reference", -1, k) for k in range(j, n)] + [("extra_payload", k, -1) for k in range(i, m)]
        elif m - i == 1 or n - j == 1 or (m - i) * (n - j) <= TABLE_CELLS:
            middle += _table(a[i:m], b[j:n], i, j, same)
        else:
            half, x = j + (n - j) // 2, a[i:m]
            left, right = _last_row(b[j:half], x, same), _last_row(b[half:n][::-1], x[::-1], same)[::-1]
            k = i + int(np.argmin(left + right))  # the first of the smallest
            todo += [(k, m, half, n), (i, k, j, half)]
    return [("match", k, k) for k in range(head)] + middle + [("match", len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _table(x: list[str], y: list[str], i: int, j: int, same: Callable[[str, str], bool]) -> list[tuple[str, int, int]]:
    cost = [list(range(len(y) + 1))]
    for r, u in enumerate(x, 1):
        row = [r]
        for c, v in enumerate(y, 1):
            row.append(min(cost[r - 1][c - 1] + (0 if same(u, v) else 2), cost[r - 1][c] + 1, row[c - 1] + 1))
        cost.append(row)
    out, r, c = [], len(x), len(y)
    while r or c:
        hit = r and c and same(x[r - 1], y[c - 1])
        if hit and cost[r][c] == cost[r - 1][c - 1]:
            r, c = r - 1, c - 1
            out.append(("match", i + r, j + c))
        elif r and c and not hit and cost[r][c] == cost[r - 1][c - 1] + 2:
            r, c = r - 1, c - 1
            out += [("extra_payload", i + r, -1), ("extra_reference", -1, j + c)]  # turned round below
        elif c and cost[r][c] == cost[r][c - 1] + 1:
            c -= 1
            out.append(("extra_reference", -1, j + c))
        else:
            r -= 1
            out.append(("extra_payload", i + r, -1))
    return out[::-1]


def align(payload: list[str], reference: list[str], mode: str = "exact", threshold: float = 0.85) -> list[dict]:
    """The edits that turn one sequence into the other, in order; a match's key is the reference's."""
    steps = _steps(*_prepared(list(payload), list(reference), mode, threshold))
    return [{"op": op, "key": reference[j] if j >= 0 else payload[i], "payload_idx": None if i < 0 else i, "reference_idx": None if j < 0 else j} for op, i, j in steps]


def alignment(payload: Column, reference: Column, mode: str = "exact", threshold: float = 0.85) -> Column:
    """C1 and C2 as a column over two arrays of strings; null arrays count as empty."""

    @F.pandas_udf(EDITS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align([] if x is None else list(x), [] if y is None else list(y), mode, threshold) for x, y in zip(a, b, strict=True)])

    return run(payload, reference)


def similarity(a: Column, b: Column) -> Column:
    """C3 as a column; null where either is."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler(p.lower(), q.lower()) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def edit_metrics(edits: DataFrame) -> DataFrame:
    """Rows (f, matches, insertions, deletions, gold, wer, accuracy) from rows (f, op)."""
    n = lambda op: F.count_if(F.col("op") == op)
    out = edits.groupBy("f").agg(n("match").alias("matches"), n("extra_payload").alias("insertions"), n("extra_reference").alias("deletions"))
    out = out.withColumn("gold", F.col("matches") + F.col("deletions"))
    out = out.withColumn("wer", F.when(F.col("gold") == 0, 0.0).otherwise((F.col("insertions") + F.col("deletions")) / F.col("gold")))
    return out.withColumn("accuracy", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("wer"))))


def category_errors(tokens: DataFrame) -> DataFrame:
    """Counts by category from rows (pos, status); punctuation is left out, a missing category is ``?``."""
    pos = F.coalesce(F.upper("pos"), F.lit("?"))
    n = lambda s: F.count_if(F.col("status") == s)
    out = tokens.select(pos.alias("pos"), "status").where("pos != 'PUNCT'").groupBy("pos")
    out = out.agg(n("match").alias("matches"), n("extra_main").alias("insertions"), n("extra_gold").alias("deletions"))
    return out.withColumn("total", F.col("matches") + F.col("deletions"))


def bag_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (f, overlap): words that two bags (f, word) share, with repeats."""
    a = left.groupBy("f", "word").agg(F.count("*").alias("n"))
    b = right.groupBy("f", "word").agg(F.count("*").alias("m"))
    return a.join(b, ["f", "word"]).groupBy("f").agg(F.sum(F.least("n", "m")).alias("overlap"))


def primary_language(df: DataFrame) -> DataFrame:
    """Rows (f, lang): the language of most rows (f, i, lang); of ties the one seen first."""
    votes = df.where("lang is not null").groupBy("f", "lang").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    return votes.groupBy("f").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("first"))).alias("lang"))


def language_list(df: DataFrame, least: int = 3) -> DataFrame:
    """Rows (f, langs): the primary language, then those of at least ``least`` rows by frequency."""
    votes = df.where("lang is not null").groupBy("f", "lang").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    w = Window.partitionBy("f").orderBy(F.desc("n"), "first")
    ranked = votes.withColumn("r", F.row_number().over(w)).where((F.col("r") == 1) | (F.col("n") >= least))
    return ranked.groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "lang"))), lambda x: x["lang"]), ",").alias("langs"))


def best_windows(windows: DataFrame) -> DataFrame:
    """For each ``g`` the window with the largest score, then the smallest length difference, then the latest end."""
    w = Window.partitionBy("g").orderBy(F.desc("score"), "delta", F.desc("end"))
    return windows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")

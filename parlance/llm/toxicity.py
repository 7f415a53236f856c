"""Toxicity categories by a chain of linear classifiers.

A chain predicts the categories ``CHAIN`` one after another.  Each link is a logistic model
over the presence of hashed words and word beginnings, and over the probabilities of the
categories before it.  While fitting, those probabilities are out-of-fold: they come from
models that saw neither the row nor, in the choice of their features, its label.

Labels mark only what is toxic at all.  The categories ``kind_1`` to ``kind_3`` are groups of
the toxic labelled rows, found from the features that set toxic rows apart: each row is put
with the group whose features it shares most (spherical k-means, seeded by the commonest features).  They
are what the labelled rows hold, not a fixed list; ``toxic`` comes last and uses them.  The
chain is fitted on at most ``FIT_ROWS`` labelled rows, by hashed id.

Results for odd input: null counts as the empty text, which has the probabilities of no
feature at all; documents are scored one by one, so repeated rows get equal results; without
labelled rows of both kinds all probabilities are 0; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.llm._common import table
from parlance.llm._common import slices
from parlance.llm.quality_mil import _sigmoid, fit_rows, held_out

GROUPS = 3
CHAIN = (*(f"kind_{k + 1}" for k in range(GROUPS)), "toxic")
FIT_ROWS = 6000
#: Rows whose words are counted at once while fitting.
SLICE = 500
BUCKETS = 1 << 18
#: Features with the largest chi-square kept for the linear models.
FEATURES = 512
FOLDS, ROUNDS, RIDGE = 3, 150, 2e-5
#: Features in more than this share of rows are left out: they tell categories apart least and slow the fit.
COMMON = 0.2
THRESHOLD = 0.5
_TRIM = ".,;:!?\"'()[]{}<>*#$%&|-_"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Pairs of a text's place and a word's code, each once; and the words."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.ascii_split_whitespace(lower)
    count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = pc.utf8_trim(coded.dictionary, _TRIM).to_pylist()
    doc, code = np.repeat(np.arange(len(count)), count), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = max(1, len(words))
    pairs = np.unique(doc * n + code)
    return pairs // n, pairs % n, words


def buckets(words: list[str]) -> np.ndarray:
    """Three buckets for each word: itself, and its first five and four characters."""
    if not words:
        return np.zeros((0, 3), dtype=np.int64)
    cut = lambda mark, n: np.array([mark + w[:n] for w in words], dtype=object)
    hashed = [pd.util.hash_array(cut(m, n), categorize=False) for m, n in (("w", None), ("5", 5), ("4", 4))]
    return (np.stack(hashed, axis=1) & np.uint64(BUCKETS - 1)).astype(np.int64)


def chosen(rows: np.ndarray, feats: np.ndarray, toxic: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The buckets with the largest chi-square for toxic rows among the rows that are ``seen``, in order."""
    own, n = seen[rows], int(seen.sum())
    there = np.bincount(feats[own], minlength=BUCKETS).astype(float)
    hit = np.bincount(feats[own], weights=toxic[rows[own]], minlength=BUCKETS)
    rate = toxic[seen].mean()
    chi = np.where((there >= 3) & (there <= COMMON * n) & (hit > there * rate), (hit - there * rate) ** 2 / np.maximum(there * rate * (1 - rate), 1e-9), 0)
    return np.sort(np.argsort(-chi, kind="stable")[:FEATURES])


def groups(x: np.ndarray, toxic: np.ndarray, k: int = GROUPS, rounds: int = 20) -> np.ndarray:
    """Labels of each row for every link of the chain: its group if it is toxic, and whether it is."""
    y = np.zeros((len(x), k + 1))
    y[:, -1] = toxic
    bad = np.flatnonzero(toxic)
    v = x[bad].astype(np.float64) * np.log(len(x) / np.maximum(x.sum(0), 1))  # rare features tell more
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    # Seeds: the rows with the feature that most toxic rows have, then with the one that most of the rest have, and so on.
    left, c = np.ones(len(bad), dtype=bool), np.zeros((k, x.shape[1]))
    for j in range(k):
        f = int((x[bad] * left[:, None]).sum(0).argmax()) if x.shape[1] else 0
        has = left & (x[bad, f] > 0) if x.shape[1] else left
        c[j] = v[has].mean(0) if has.any() else v.mean(0)
        left &= ~has
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        sums = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(k)])
        c = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    y[bad, own] = 1
    return y


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept last, by Nesterov's gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    scale = 4.0 / max(1e-9, float((x**2).sum(1).mean()))
    w = np.zeros(x.shape[1])
    v, ahead = w.copy(), w.copy()
    for k in range(ROUNDS):
        g = x.T @ ((_sigmoid(x @ ahead.astype(x.dtype)) - y) / len(y)).astype(x.dtype) + RIDGE * ahead
        new = ahead - scale * g
        ahead = new + k / (k + 3) * (new - v)
        v = new
    return v


class Chain:
    """A fitted chain: the buckets that its linear models read and the weights of each link."""

    def __init__(self, chosen: np.ndarray, links: list[np.ndarray]):
        self.chosen, self.links = chosen, links
        self.place = np.full(BUCKETS, len(chosen), dtype=np.int64)
        self.place[chosen] = np.arange(len(chosen))

    @staticmethod
    def fit(texts: pa.Array, toxic: np.ndarray) -> Chain:
        toxic = (toxic > 0).astype(np.float64)
        if len(np.unique(toxic)) < 2:
            return Chain(np.zeros(0, dtype=np.int64), [np.array([0.0] * k + [-40.0]) for k in range(len(CHAIN))])
        n = len(toxic)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, n, SLICE):
            doc, code, words = tokens(texts.slice(at, SLICE))
            pairs = np.unique(np.repeat(doc, 3) * BUCKETS + buckets(words)[code].ravel())
            parts.append(((pairs // BUCKETS + at).astype(np.int32), (pairs % BUCKETS).astype(np.int32)))
        rows, feats = (np.concatenate(x) for x in zip(*parts, strict=True))
        fold = np.random.default_rng(n).permutation(n) % FOLDS

        def matrix(seen: np.ndarray) -> tuple[Chain, np.ndarray]:
            """A chain that reads the features which the rows seen choose, and those features of all rows."""
            own = Chain(chosen(rows, feats, toxic, seen), [])
            x = np.zeros((n, len(own.chosen) + 1), dtype=np.float32)
            x[rows, own.place[feats]] = 1
            return own, x[:, :-1]

        chain, x = matrix(np.ones(n, dtype=bool))
        y = groups(x, toxic)
        # Out-of-fold probabilities of every link: features, and the links before, are of the other folds alone.
        before = np.zeros((n, len(CHAIN)), dtype=np.float32)
        for f in range(FOLDS):
            seen, out = fold != f, fold == f
            own = matrix(seen)[1]
            inner = np.zeros((n, 0), dtype=np.float32)
            for j in range(len(CHAIN)):
                z = np.hstack([own, inner])
                w = _logistic(z[seen], y[seen, j])
                p = _sigmoid(z @ w[:-1] + w[-1]).astype(np.float32)
                before[out, j] = p[out]
                inner = np.hstack([inner, p[:, None]])
        for j in range(len(CHAIN)):
            chain.links.append(_logistic(np.hstack([x, before[:, :j]]), y[:, j]))
        return chain

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """A row for each text, a column for each category."""
        n, m = len(texts), len(self.chosen)
        doc, code, words = tokens(texts)
        place = self.place[buckets(words)]
        known = (place < m).any(1)
        keep = known[code]
        doc, at = doc[keep], place[code[keep]]
        pairs = np.unique(np.repeat(doc, 3) * (m + 1) + at.ravel())
        rows, feats = pairs // (m + 1), pairs % (m + 1)
        rows, feats = rows[feats < m], feats[feats < m]
        out = np.zeros((n, len(self.links)))
        for j, w in enumerate(self.links):
            score = np.bincount(rows, weights=w[feats], minlength=n) + out[:, :j] @ w[m : m + j] + w[-1]
            out[:, j] = _sigmoid(score)
        return out


def toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """Rows (doc_id, a probability for each category)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = chain.probabilities(part["text"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(p[:, j]) for j in range(len(CHAIN)))], names=["doc_id", *(f"p_{c}" for c in CHAIN)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in CHAIN))


def fitted(docs: DataFrame, labels: DataFrame) -> Chain:
    texts, y = fit_rows(docs, labels, "toxic", FIT_ROWS)
    return Chain.fit(texts, y)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), *(f"p_{c}" for c in CHAIN), (F.col("p_toxic") >= THRESHOLD).alias("toxic"))

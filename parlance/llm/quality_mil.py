"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, runs of ``PASSAGE`` bytes that together are its whole text.
Each passage is encoded from its character classes and hashed byte trigrams; a gated
attention layer, learned from document labels alone, weighs the passages, and a linear
layer scores the weighted representation.  The network is fitted on at most ``FIT_ROWS``
labelled rows, those with the smallest hashed ids among the rows not held out.

Results for odd input: null counts as the empty text, which is one empty passage with a
score of its own; a score depends on its text alone to the last bit, so repeated rows get
equal scores; of several texts under one labelled id the greatest is fitted on;
labels, lang, source and doc_id are never inputs; without labelled rows of both kinds every
score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.llm._common import table
from parlance.llm._common import slices

PASSAGE = 512
FIT_ROWS = 4000
#: Rows that are encoded at once while fitting.
SLICE = 200
FOLDS = 5
HIDDEN, ATTEND, TRIGRAMS = 24, 12, 192
EPOCHS, BATCH, STEP, DECAY = 12, 64, 0.01, 1e-4
THRESHOLD = 0.3
SEED = 5

#: One class for each printable sign, one each for digits, capitals, small letters, white space, other controls, UTF-8 heads and tails.
_SIGNS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
N_CLASSES = len(_SIGNS) + 7


def _class_table() -> np.ndarray:
    out = np.full(256, N_CLASSES - 3, dtype=np.int64)
    for k, c in enumerate(_SIGNS):
        out[c] = k
    n = len(_SIGNS)
    out[48:58], out[65:91], out[97:123] = n, n + 1, n + 2
    out[[9, 10, 11, 12, 13, 32]] = n + 3
    out[0xC0:], out[0x80:0xC0] = N_CLASSES - 2, N_CLASSES - 1
    return out


_CLASS = _class_table()
N_INPUTS = N_CLASSES + TRIGRAMS + 1


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of each passage of all texts, and the place of the text that each belongs to."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    raw = pa.concat_arrays([raw])
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    size = np.diff(ends)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(count) - count
    pos = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size)
    row = np.repeat(first, size) + pos // PASSAGE
    n = int(count.sum())
    kinds = np.bincount(row * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    three = np.flatnonzero(pos < np.repeat(size, size) - 2)  # none spans two texts
    wide = data.astype(np.uint32)
    h = (wide[three] * np.uint32(0x9E3779B1)) ^ (wide[three + 1] * np.uint32(0x85EBCA6B)) ^ (wide[three + 2] * np.uint32(0xC2B2AE35)) if len(three) else np.zeros(0, dtype=np.uint32)
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)) % np.uint32(TRIGRAMS)
    grams = np.bincount(row[three] * TRIGRAMS + h.astype(np.int64), minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    total = np.maximum(kinds.sum(1, keepdims=True), 1)
    out = np.concatenate([np.sqrt(kinds / total), np.sqrt(grams / total), np.minimum(total, PASSAGE) / PASSAGE], axis=1)
    return out.astype(np.float32), np.repeat(np.arange(len(size)), count)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _grid(x: np.ndarray) -> np.ndarray:
    """Multiples of 2^-20, at most 32 in size.

    In every product here one factor is at most 1 and a row of them sums to less than 2^8,
    so that sums of products have 40 bits after the point and 13 before it: exact.
    """
    return np.rint(np.clip(x.astype(np.float64), -32, 32) * 2.0**20) / 2.0**20


class AttentionMil:
    """The network's parameters and its forward and backward passes."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        init = lambda a, b: (rng.standard_normal((a, b)) * np.sqrt(1 / a)).astype(np.float32)
        self.w = {"enc": init(N_INPUTS, HIDDEN) * 3, "enc0": np.zeros(HIDDEN, np.float32), "v": init(HIDDEN, ATTEND), "u": init(HIDDEN, ATTEND), "a": init(ATTEND, 1)[:, 0], "out": init(HIDDEN, 1)[:, 0], "out0": np.zeros(1, np.float32)}
        self.constant = False

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
        w = self.w
        h = np.tanh(x @ w["enc"] + w["enc0"])
        tv, su = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        e = (tv * su) @ w["a"]
        most = np.full(n, -np.inf)
        np.maximum.at(most, bag, e)
        a = np.exp(e - most[bag])
        a /= np.bincount(bag, weights=a, minlength=n)[bag]
        z = np.zeros((n, HIDDEN))
        np.add.at(z, bag, a[:, None] * h)
        return {"h": h, "tv": tv, "su": su, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["out0"][0])}

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict:
        w, f = self.w, self.forward(x, bag, len(y))
        d = (f["p"] - y) / len(y)
        g = {"out": f["z"].T @ d, "out0": np.array([d.sum()])}
        dz = d[:, None] * w["out"]
        da = (dz[bag] * f["h"]).sum(1)
        de = f["a"] * (da - np.bincount(bag, weights=f["a"] * da, minlength=len(y))[bag])
        g["a"] = (f["tv"] * f["su"]).T @ de
        gate = de[:, None] * w["a"]
        dv, du = gate * f["su"] * (1 - f["tv"] ** 2), gate * f["tv"] * f["su"] * (1 - f["su"])
        g["v"], g["u"] = f["h"].T @ dv, f["h"].T @ du
        dh = f["a"][:, None] * dz[bag] + dv @ w["v"].T + du @ w["u"].T
        dh *= 1 - f["h"] ** 2
        g["enc"], g["enc0"] = x.T @ dh, dh.sum(0)
        return g

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, seed: int = SEED) -> AttentionMil:
        """Adam over batches of documents; ``bag`` rises."""
        if len(np.unique(y)) < 2:
            self.constant = True
            return self
        start = np.searchsorted(bag, np.arange(len(y) + 1))
        m = {k: np.zeros_like(v, dtype=np.float64) for k, v in self.w.items()}
        s = {k: np.zeros_like(v, dtype=np.float64) for k, v in self.w.items()}
        rng, t = np.random.default_rng(seed), 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                docs = order[at : at + BATCH]
                rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in docs])
                own = np.repeat(np.arange(len(docs)), start[docs + 1] - start[docs])
                g, t = self.gradients(x[rows], own, y[docs]), t + 1
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    step = STEP * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
                    self.w[k] = (self.w[k] * (1 - STEP * DECAY) - step).astype(np.float32)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores of texts, each the same to the last bit whatever texts stand beside it.

        What enters a product of matrices is rounded to a grid of powers of two first, so
        that every sum of products is exact in a double and its order does not matter; sums
        over a document's passages run in the order of the passages.
        """
        if self.constant:
            return np.full(len(texts), 0.5)
        x, bag = passages(texts)
        n, w = len(texts), {k: _grid(v) for k, v in self.w.items()}
        h = _grid(np.tanh(_grid(x) @ w["enc"] + w["enc0"]))
        gate = _grid(np.tanh(h @ w["v"]) * _sigmoid(h @ w["u"]))
        e = gate @ w["a"]
        most = np.full(n, -np.inf)
        np.maximum.at(most, bag, e)
        a = np.exp(e - most[bag])
        a /= np.bincount(bag, weights=a, minlength=n)[bag]
        z = np.stack([np.bincount(bag, weights=a * h[:, j], minlength=n) for j in range(HIDDEN)], axis=1)
        return _sigmoid(_grid(z) @ w["out"] + w["out0"][0])


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels to fit on: labelled rows not held out, at most ``rows``, by hashed id."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # Of texts under one id the greatest is taken, so that reruns fit on the same rows.
    got = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")).orderBy("doc_id").toArrow()
    return pa.concat_arrays(got["text"].chunks) if got.num_rows else pa.array([], pa.string()), got["y"].to_numpy().astype(np.float64)


def held_out():
    """Whether crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fitted(docs: DataFrame, labels: DataFrame) -> AttentionMil:
    texts, y = fit_rows(docs, labels, "quality")
    if len(y) == 0:
        model = AttentionMil()
        model.constant = True
        return model
    parts = [passages(texts.slice(at, SLICE)) for at in range(0, len(texts), SLICE)]
    bag = np.concatenate([b + k * SLICE for k, (_, b) in enumerate(parts)])
    return AttentionMil().fit(np.concatenate([x for x, _ in parts]), bag, y)


def quality(docs: DataFrame, model: AttentionMil) -> DataFrame:
    """Rows (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(model.score(part["text"]), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))

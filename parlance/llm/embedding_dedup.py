"""Near-duplicate embeddings through an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted by k-means on a sample
(``FIT_ROWS`` vectors, or ``PER_CODE`` for each code if that is more); their product is a grid of
cells into which every vector is put, with about ``PER_CELL`` vectors in each.  A query
visits the cells nearest to it, in the order of its squared distances from their two codes
(multi-sequence traversal), until the target recall: as many cells as find ``RECALL`` of vectors
turned just as far as the threshold allows, which is set on ``CALIBRATE`` rows.  Cells whose
border is farther away than a link is long are passed over, as nothing there can link.
Vectors in visited cells are verified by their cosine in double precision.

Of two cells only the lower one's vectors visit the other, so each pair is compared once.
A query is sent once to each group of neighbouring cells that it visits; groups with many
members are split into blocks.  A block adds up link counts, and passes on only the edges of a
forest that spans its links, never all pairs.  A cell with very many members has a leader:
members within half the angle of a link from it all link with each other, so they are counted
by their number and not compared.

Results for odd input: equal vectors are compared once and count as links of each other;
vectors that are null, empty, zero, or hold null or non-finite components link with nothing
and are kept; vectors of different lengths do not link; labels are ignored, as are other
columns; rows that repeat an id and a vector count as vectors of their own, and different
vectors under one id may link; ids may be of any type that has an order; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.llm._common import cut, in_batches, keyed_join, release, table
from parlance.llm.graph import components

COSINE = 0.95
FIT_ROWS, PER_CODE = 20_000, 32
#: Vectors in a cell, about; codes of a codebook, at most; vectors in a group of cells, about.
PER_CELL, MOST_CODES, PER_GROUP = 128, 2048, 8192
#: Share of the faintest links that a query's own traversal is to find, and vectors on which that is set.
RECALL, CALIBRATE = 0.995, 2000
ROUNDS = 8
#: Members of a block, and of a cell that gets a leader.
BLOCK, HEAVY = 16_384, 16_384
QUERIES = 256
#: Lengths of vectors that get an index of their own, those with the most vectors; others are compared within their length.
LENGTHS = 8
SEED = 3


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that no square is lost or overflows
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (codes * codes).sum(1)[None, :] - 2 * x @ codes.T, 0))


def codebook(x: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """Centres of ``k`` clusters of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = distances(x, codes).argmin(1)
        count = np.bincount(near, minlength=len(codes))
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=len(codes)) for j in range(x.shape[1])], axis=1)
        codes = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], codes)
    return codes


def n_codes(n: int) -> int:
    return int(min(MOST_CODES, max(1, round((n / PER_CELL) ** 0.5))))


class MultiIndex:
    """Codebooks, groups of cells, and how many cells a query visits."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float = COSINE):
        self.half, k = sample.shape[1] // 2 or sample.shape[1], n_codes(n)
        x = unit(sample)
        self.codes = [codebook(x[:, : self.half], k), codebook(x[:, self.half :], k)] if x.shape[1] > 1 else [codebook(x, k), np.zeros((1, 0))]
        if x.shape[1] > 2:  # in the order of their longest axis, so that codes beside each other are near
            middle = self.codes[0] - self.codes[0].mean(0)
            self.codes[0] = self.codes[0][np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]
        self.k = [len(c) for c in self.codes]
        self.apart = [np.maximum(distances(c, c), 1e-12) for c in self.codes]
        #: Codes of the first and of the second half that a group of cells has, and groups beside each other.
        cells = max(1, round(PER_GROUP * self.k[0] * self.k[1] / max(1, n)))
        self.width, self.tall = min(self.k[1], cells), max(1, cells // self.k[1])
        self.across = -(-self.k[1] // self.width)
        self.reach = 2 * (1 - cosine) + 1e-9  # squared length of the longest link
        self.calibrate(x[:CALIBRATE], cosine)

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [distances(x[:, : self.half], self.codes[0]), distances(x[:, self.half :], self.codes[1])]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of each unit vector."""
        near = [m.argmin(1) for m in self.halves(x)]
        return near[0] * self.k[1] + near[1]

    def groups(self, cells: np.ndarray) -> np.ndarray:
        return cells // self.k[1] // self.tall * self.across + cells % self.k[1] // self.width

    def calibrate(self, x: np.ndarray, cosine: float, recall: float = RECALL, seed: int = SEED) -> None:
        """Sets how many cells a query visits: as many as find the share ``recall`` of vectors that are just near enough to link."""
        noise = np.random.default_rng(seed).standard_normal(x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-12)
        there = self.cells(cosine * x + np.sqrt(1 - cosine**2) * noise)
        rank = []
        for at in range(0, len(x), QUERIES):
            d, t = self.halves(x[at : at + QUERIES]), there[at : at + QUERIES]
            own = d[0][np.arange(len(t)), t // self.k[1]] ** 2 + d[1][np.arange(len(t)), t % self.k[1]] ** 2
            rank += [int(((p[:, None] ** 2 + q[None, :] ** 2) < o).sum()) for p, q, o in zip(*d, own, strict=True)]
        self.most = int(np.quantile(rank, recall, method="higher")) + 1
        # In the traversal's order the n-th cell is a pair of places whose product is at most n.
        reach = [min(k, self.most) for k in self.k]
        i, j = np.meshgrid(np.arange(reach[0]), np.arange(reach[1]), indexing="ij")
        near = (i + 1) * (j + 1) <= self.most
        self.first, self.second = i[near], j[near]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, cell): the cells that each query's traversal visits, but for those that nothing near enough can be in."""
        d = self.halves(x)
        order = [np.argsort(m, axis=1, kind="stable")[:, : self.most] for m in d]
        near = [np.take_along_axis(m, o, axis=1) ** 2 for m, o in zip(d, order, strict=True)]
        total = near[0][:, self.first] + near[1][:, self.second]
        pick = np.argsort(total, axis=1, kind="stable")[:, : self.most]
        # The border between two codes is where both are as far; a vector there is at least this far away.
        gap = [np.maximum((q - q[:, :1]) / (2 * a[o[:, :1], o]), 0) ** 2 for q, a, o in zip(near, self.apart, order, strict=True)]
        bound = gap[0][:, self.first] + gap[1][:, self.second]
        cell = order[0][:, self.first] * self.k[1] + order[1][:, self.second]
        keep = np.take_along_axis(bound, pick, axis=1) <= self.reach
        return np.nonzero(keep)[0], np.take_along_axis(cell, pick, axis=1)[keep]


class OneCell:
    """Stands for an index where vectors are few: those of one length are one cell, and nothing else is visited."""

    def groups(self, cells: np.ndarray) -> np.ndarray:
        return cells

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), x.shape[1], dtype=np.int64)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(x)), self.cells(x)


def packed(vector: np.ndarray) -> bytes:
    """A vector's bytes: in single precision where that holds it exactly, else in double; a mark tells which."""
    v = np.asarray(vector, dtype=np.float64) + 0.0
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return b"f" + single.tobytes() if (single == v).all() else b"d" + v.tobytes()


def unpacked(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length, in double precision."""
    return np.stack([np.frombuffer(b, dtype=np.float32 if b[:1] == b"f" else np.float64, offset=1).astype(np.float64) for b in column.to_pylist()])


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (x, least of x's component) of the graph with edges (a, b)."""
    names, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = inverse[: len(a)], inverse[len(a) :]
    least = np.arange(len(names))
    while True:
        new = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == least).all():
            break
        least = new
    apart = least != np.arange(len(names))
    return np.stack([names[apart], names[least[apart]]], axis=1)


_FOUND = "id binary, n long, other binary"
_DEALT = "grp long, core int, block int, query int, cells array<int>, id binary, m long, vec binary"


def _verified(rows: DataFrame, cosine: float) -> DataFrame:
    """Link counts (other is null) and spanning edges (n is null) from the members and queries of each block."""

    def linked(ids: pa.Array, m: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """What pairs of rows (by place) add up to."""
        if not pairs:
            return
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        count = np.bincount(a, weights=m[b], minlength=len(m)) + np.bincount(b, weights=m[a], minlength=len(m))
        some, edges = np.flatnonzero(count), _spanning(a, b)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(count[some].astype(np.int64)), pa.nulls(len(some), pa.binary())], names=["id", "n", "other"])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(edges[:, 0])), pa.nulls(len(edges), pa.int64()), ids.take(pa.array(edges[:, 1]))], names=["id", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, members = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, core, block, query = (batch[k].to_numpy() for k in ("grp", "core", "block", "query"))
            cuts = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in (grp, core, block, query)], axis=0)))
            for s, e in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if (grp[s], core[s], block[s]) != now:
                    if now is not None and members is None:
                        yield from within(parts, now)
                    now, parts, members = (grp[s], core[s], block[s]), [], None
                part = batch.slice(s, e - s)
                if not query[s]:
                    parts.append(part)
                    continue
                if members is None:
                    yield from within(parts, now)
                    members = ready(parts)
                if members is not None:
                    yield from asked(part, members)
        if now is not None and members is None:
            yield from within(parts, now)
        release()

    def ready(parts: list[pa.RecordBatch]) -> tuple | None:
        """Ids, weights, unit vectors, and cells of a block's members, by cell."""
        if not parts:
            return None
        t = pa.Table.from_batches(parts).combine_chunks()
        cell = t["cells"].combine_chunks().flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        t = t.take(pa.array(order))
        return t["id"].combine_chunks(), t["m"].to_numpy(), unit(unpacked(t["vec"].combine_chunks())), cell[order]

    def within(parts: list[pa.RecordBatch], now: tuple) -> Iterator[pa.RecordBatch]:
        """Links between members of one cell; those of a core are known already."""
        members = None if now[1] else ready(parts)
        if members is None:
            return
        ids, m, vec, cell = members
        pairs = []
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        for s, e in zip(starts, [*starts[1:], len(cell)], strict=True):
            for at in range(s, e, QUERIES):
                end = min(e, at + QUERIES)
                a, b = np.nonzero(vec[at:end] @ vec[at:e].T >= cosine)
                upper = b > a
                pairs.append((a[upper] + at, b[upper] + at))
        yield from linked(ids, m, [p for p in pairs if len(p[0])])

    def asked(part: pa.RecordBatch, members: tuple) -> Iterator[pa.RecordBatch]:
        """Links between queries and the members of the cells that they visit."""
        ids, m, vec, cell = members
        lists = part["cells"]
        wanted = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
        low, high = np.searchsorted(cell, wanted, side="left"), np.searchsorted(cell, wanted, side="right")
        some = np.flatnonzero(high > low)
        if not len(some):
            return
        q, pairs = unit(unpacked(part["vec"])), []
        some = some[np.argsort(wanted[some], kind="stable")]
        starts = np.flatnonzero(np.append(True, wanted[some][1:] != wanted[some][:-1]))
        for s, e in zip(starts, [*starts[1:], len(some)], strict=True):
            a, b = low[some[s]], high[some[s]]
            for at in range(s, e, QUERIES):
                who = owner[some[at : min(e, at + QUERIES)]]
                x, y = np.nonzero(q[who] @ vec[a:b].T >= cosine)
                pairs.append((who[x] + len(m), y + a))
        every = pa.concat_arrays([ids, part["id"]])
        yield from linked(every, np.concatenate([m, part["m"].to_numpy()]), [p for p in pairs if len(p[0])])

    return in_batches(rows).mapInArrow(run, _FOUND)


def _links(vectors: DataFrame, index: MultiIndex | OneCell, cosine: float) -> DataFrame:
    """As ``_verified``, for different vectors (id, m, vec)."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _of_one_length(batch):
                cell = index.cells(unit(unpacked(part["vec"])))
                yield pa.RecordBatch.from_arrays([part["id"], part["m"], part["vec"], pa.array(cell), pa.array(index.groups(cell))], names=["id", "m", "vec", "cell", "grp"])

    placed = in_batches(vectors.select("id", "m", "vec")).mapInArrow(put, "id binary, m long, vec binary, cell long, grp long")
    # Cells and groups with more than some thousands of vectors: at most one for each so many vectors.
    counts = cut(placed.groupBy("grp", "cell").agg(F.count("*").alias("n"), F.min("id").alias("leader")))
    heavy = {r.cell: r for r in counts.where(F.col("n") > HEAVY).join(vectors.select(F.col("id").alias("leader"), "vec"), "leader").collect()}
    full = {r.grp: -(-int(r.n) // BLOCK) for r in counts.where(F.col("n") <= HEAVY).groupBy("grp").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).collect()}
    leaders = {c: unit(unpacked(pa.array([bytes(r.vec)])))[0] for c, r in heavy.items()}
    blocks = {c: -(-int(r.n) // BLOCK) for c, r in heavy.items()}
    core_cos, near_cos = np.cos(np.arccos(cosine) / 2) + 1e-9, np.cos(min(np.pi, 1.5 * np.arccos(cosine))) - 1e-9
    heavy_cells = np.array(sorted(heavy), dtype=np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p for x in _of_one_length(batch) for p in _runs(x)):
                yield from deal(part, unit(unpacked(part["vec"])))
        release()

    def deal(part: pa.RecordBatch, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = index.cells(x)
        grp, hashed = index.groups(own), np.frombuffer(b"".join(b[:4] for b in part["id"].to_pylist()), dtype=np.uint32).astype(np.int64)
        core = np.array([int(c in leaders and x[k] @ leaders[c] >= core_cos) for k, c in enumerate(own.tolist())], dtype=np.int64)
        out: list[tuple[int, int, int, int, list[int], int]] = []  # group, core, block, query, cells, row
        row, cell = index.visits(x)
        up = cell > own[row]
        row, cell = row[up], cell[up]
        for k in range(len(x)):
            c = int(own[k])
            n = blocks[c] if c in leaders else full.get(int(grp[k]), 1)
            g, mine = (-1 - c if c in leaders else int(grp[k])), int(hashed[k] % n)
            out.append((g, int(core[k]), mine, 0, [c], k))
            if not core[k]:
                out += [(g, 0, j, 1, [c], k) for j in range(mine + 1, n)]
                if c in leaders:
                    out += [(g, 1, j, 1, [c], k) for j in range(n)]
        light = ~np.isin(cell, heavy_cells)
        for k, c in zip(row[~light].tolist(), cell[~light].tolist(), strict=True):
            kinds = (0, 1) if x[k] @ leaders[c] >= near_cos else (0,)
            out += [(-1 - c, kind, j, 1, [c], k) for kind in kinds for j in range(blocks[c])]
        row, cell = row[light], cell[light]
        to = index.groups(cell)
        order = np.lexsort((cell, to, row))
        row, cell, to = row[order], cell[order], to[order]
        starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (to[1:] != to[:-1]))) if len(row) else np.zeros(0, dtype=np.int64)
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(row)).tolist(), strict=False):
            g = int(to[s])
            out += [(g, 0, j, 1, cell[s:e].tolist(), int(row[s])) for j in range(full.get(g, 1))]
        cols = list(zip(*out, strict=True))
        take = pa.array(cols[5], pa.int64())
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols[:5], kinds, strict=True)), *(part[k].take(take) for k in ("id", "m", "vec"))], names=["grp", "core", "block", "query", "cells", "id", "m", "vec"])

    rows = in_batches(vectors.select("id", "m", "vec")).mapInArrow(dealt, _DEALT)
    n = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.agg(F.sum("n")).first()[0] // 20_000)
    found = _verified(rows.repartition(n, "grp", "core", "block").sortWithinPartitions("grp", "core", "block", "query"), cosine)
    if not heavy:
        return found

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _of_one_length(batch):
                x = unit(unpacked(part["vec"]))
                cell = index.cells(x)
                inside = np.flatnonzero([c in leaders and x[k] @ leaders[c] >= core_cos for k, c in enumerate(cell.tolist())])
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(inside)), part["m"].take(pa.array(inside)), pa.array(cell[inside])], names=["id", "m", "cell"])

    inner = cut(in_batches(vectors.select("id", "m", "vec")).mapInArrow(cores, "id binary, m long, cell long"))
    sums = inner.groupBy("cell").agg(F.sum("m").alias("every"), F.min("id").alias("head"))
    met = inner.join(F.broadcast(sums), "cell")  # as many rows as there are leaders, which the driver holds anyway
    none = F.lit(None)
    return found.union(met.select("id", (F.col("every") - F.col("m")).alias("n"), none.cast("binary").alias("other"))).union(met.where("id != head").select("id", none.cast("long").alias("n"), F.col("head").alias("other")))


def _of_one_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.array([(len(b) - 1) // (4 if b[:1] == b"f" else 8) for b in batch["vec"].to_pylist()], dtype=np.int64)
    for n in np.unique(size):
        yield batch if (size == n).all() else batch.take(pa.array(np.flatnonzero(size == n)))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, QUERIES):
        yield batch.slice(at, QUERIES)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each vector."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    vec = F.when(fine, v)

    @F.pandas_udf("binary")
    def pack(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else packed(x))

    # The digest names a vector in what follows, as ids may stand for several.
    rows = in_batches(embeddings.select("vec_id", vec.alias("v"))).select("vec_id", F.size("v").alias("size"), pack("v").alias("vec"))
    rows = rows.withColumn("vec", F.explode_outer(F.array("vec"))).withColumn("id", F.unhex(F.md5("vec")))
    named = cut(rows.select("vec_id", "id"))
    classes = cut(rows.where("vec is not null").groupBy("id").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"), F.first("vec").alias("vec"), F.first("size").alias("size")))
    sizes = classes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(LENGTHS + 1).collect()
    alone = named.where("id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone
    parts = []
    for size, n in sizes[:LENGTHS]:
        own = classes.where(F.col("size") == size)
        sample = own.orderBy("id").limit(max(FIT_ROWS, PER_CODE * n_codes(n))).select("vec").toArrow()
        parts.append(_links(own, MultiIndex(unpacked(sample["vec"].combine_chunks()), n, cosine), cosine))
    if len(sizes) > LENGTHS:
        parts.append(_links(classes.where(~F.col("size").isin(*[s for s, _ in sizes[:LENGTHS]])), OneCell(), cosine))
    found = parts[0]
    for other in parts[1:]:
        found = found.union(other)
    found = cut(found)
    links = found.where("n is not null").groupBy("id").agg(F.sum("n").alias("links"))
    comp = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    one = classes.select("id", "first", "m").join(links, "id", "left").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    one = cut(one)
    least = one.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    one = keyed_join(one, least, ["component"], one.count()).select("id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.col("m").alias("n"))
    out = keyed_join(named.where("id is not null"), one, ["id"], named.count())
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")).union(alone)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

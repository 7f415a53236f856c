"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A shingle is five consecutive words of the lower-cased text (all words of a shorter one).
Its weight is (1 + ln tf) times the mean smoothed idf of its words, 1 + ln((1+N)/(1+df)) /
ln(1+N).  Document frequencies are counted over all documents in ``DF_BUCKETS`` hashed
buckets, so that the table that workers hold has a fixed size; a table of all shingles
would grow with the corpus.  ICWS draws ``BANDS * ROWS`` samples; texts that agree on all
rows of a band meet in a bucket, and every pair of a bucket is verified by its weighted
Jaccard similarity over whole texts.

A bucket never emits its pairs: a task compares a block of its members, or two, by a product
of matrices and emits the edges of a forest that spans the links found.  The members of a
bucket with more than one block are first compared with a leader, the member with the smallest
id; those that link with it are one component.  Weighted Jaccard distance obeys the triangle
inequality, so members whose distances from the leader differ by more than a link's can't
link: the rest falls into shells around the leader, and only the blocks of a shell and its
neighbours, but not those of the innermost one among themselves, are compared in pairs.  A
bucket of near copies of one text thus sends each text about once.

Results for odd input: equal texts form one class before anything is compared; null counts
as the empty text; a text without words is like no text but an equal one.  A class is named
by its smallest doc_id.  An id that stands for several texts is a document for each of them:
none loses a link, and of those in one class the one with the smallest digest is kept; rows
that repeat an id and its text get equal results.  Rows with a null id are their own class, which is null, and
kept.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parlance.llm._common import cut, in_batches, keyed_join, release, slices, stored, table, text_of
from parlance.llm.graph import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
DF_BUCKETS = 1 << 18
#: Random variates are taken from a pool of this size, another place for each sample.
POOL = 1 << 17
#: Members of a block, and shared layers that are multiplied at once.
BLOCK, COLUMNS = 256, 8192
#: Shells around a leader, the last one open; at least as many as fit between distances 0 and 1.
SHELLS = 6
SEED = 7
#: Ids that are broadcast at most (16 MB).
BROADCAST_IDS = 2_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 44) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_strings(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of strings, and which are empty: polynomials of their bytes, from running sums over all of them."""
    names = pa.concat_arrays([names.cast(pa.large_binary())])
    if not len(names):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    ends = np.frombuffer(names.buffers()[1], dtype=np.int64)[names.offset : names.offset + len(names) + 1]
    n = int(ends[-1] - ends[0])
    data = np.frombuffer(names.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if n else np.zeros(0, dtype=np.uint8)
    powers = np.cumprod(np.append(np.uint64(1), np.full(n, _P, dtype=np.uint64)))
    inverse = np.cumprod(np.append(np.uint64(1), np.full(n, pow(int(_P), -1, 1 << 64), dtype=np.uint64)))
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64))
    a, b = ends[:-1] - ends[0], ends[1:] - ends[0]
    return _mix((sums[b] - sums[a]) * inverse[a]), a == b


def words_hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts)))
    count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    hashes, empty = _hash_strings(coded.dictionary)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if empty.any():  # the only word of a text without words
        blank = empty[codes]
        count = count - np.bincount(np.repeat(np.arange(len(count)), count)[blank], minlength=len(count))
        codes = codes[~blank]
    return hashes[codes], count


def weighted(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place of the text, 44-bit hash and weight of each different shingle, sorted by the first two; then its tf and idf."""
    wh, count = words_hashed(texts)
    n, ends = len(wh), np.cumsum(count)
    value = idf[(wh & np.uint64(len(idf) - 1)).astype(np.int64)].astype(np.float64)
    doc = np.repeat(np.arange(len(count)), count)
    after = ends[doc] - np.arange(n) if n else np.zeros(0, dtype=np.int64)
    first = np.zeros(n, dtype=bool)
    first[(ends - count)[count > 0]] = True
    size = np.where(after >= WORDS, WORDS, 0)
    size[first] = np.minimum(after[first], WORDS)  # a shorter text is one shingle
    at = np.flatnonzero(size)
    size = size[at]
    h, w = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at))
    for j in range(WORDS):
        there = size > j
        k = np.minimum(at + j, n - 1)
        h = np.where(there, (h ^ wh[k]) * _P + np.uint64(j), h)
        w += np.where(there, value[k], 0.0)
    w /= np.maximum(size, 1)
    key = (doc[at].astype(np.uint64) << np.uint64(44)) | (_mix(h) & _LOW)
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    tf = np.diff(np.append(new, len(key)))
    return (key[new] >> np.uint64(44)).astype(np.int64), key[new] & _LOW, w[new] * (1 + np.log(tf)), tf, w[new]


def _pool(seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    r, log_c = rng.gamma(2.0, 1.0, POOL), np.log(rng.gamma(2.0, 1.0, POOL))
    return r.astype(np.float32), log_c.astype(np.float32), rng.random(POOL).astype(np.float32)


def samples(doc: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, pool: tuple[np.ndarray, ...]) -> np.ndarray:
    """ICWS samples, a row of ``SAMPLES`` 32-bit words for each of ``n`` texts; rows of texts without shingles are 0.

    Of each sample the shingle and its quantised weight, hashed to 32 bits, are kept.
    """
    out = np.zeros((n, SAMPLES), dtype=np.uint32)
    if not len(doc):
        return out
    r, log_c, beta = pool
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    log_s = np.log(weights).astype(np.float32)
    mixed = _mix(ids)
    place, step = mixed.astype(np.uint32), ((mixed >> np.uint64(32)).astype(np.uint32) | np.uint32(1))
    tag = (ids ^ (ids >> np.uint64(20))).astype(np.uint32)
    for k in range(SAMPLES):
        slot = (place + np.uint32(k) * step) & np.uint32(POOL - 1)
        rk, bk = r[slot], beta[slot]
        t = np.floor(log_s / rk + bk)
        # Positive floats keep their order as integers, so the least value and its tag are found together.
        value = np.maximum(log_c[slot] - rk * (t - bk + 1) + np.float32(4096), np.float32(0)).view(np.uint32)
        sample = tag ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        least = np.minimum.reduceat((value.astype(np.uint64) << np.uint64(32)) | sample, head)
        out[doc[head], k] = (least & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` signed 64-bit keys for each row of samples."""
    keys = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, dtype=np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = _mix((h ^ sig[:, k].astype(np.uint64)) * _P)
        keys[:, b] = h
    return keys.view(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Smoothed idf of each hashed bucket, and the number of documents; counted over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DF_BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch):
                wh, count = words_hashed(part["text"])
                doc = np.repeat(np.arange(len(count), dtype=np.int64), count)
                seen = np.unique((doc * DF_BUCKETS) + (wh & np.uint64(DF_BUCKETS - 1)).astype(np.int64))
                total += np.bincount(seen % DF_BUCKETS, minlength=DF_BUCKETS)
                n += len(count)
        some = np.flatnonzero(total)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["b", "df"])

    rows = in_batches(docs.select("text")).mapInArrow(run, "b long, df long").groupBy("b").agg(F.sum("df").alias("df")).toPandas()
    n = int(rows.loc[rows.b < 0, "df"].sum())
    df = np.zeros(DF_BUCKETS)
    rows = rows[rows.b >= 0]
    df[rows.b.to_numpy()] = rows.df.to_numpy()
    return (1 + np.log((1 + n) / (1 + df)) / np.log(2 + n)).astype(np.float32), n


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Rows (doc_id, keys) for the documents with words: a key for each band of ICWS samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _pool()
        for batch in batches:
            for part in slices(batch):
                doc, ids, weights = weighted(part["text"], idf)[:3]
                some = np.unique(doc)
                keys = band_keys(samples(doc, ids, weights, part.num_rows, pool)[some])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(some) + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(some)), keys], names=["doc_id", "keys"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, keys array<bigint>")


def _buckets(sigs: DataFrame) -> DataFrame:
    """Rows (key, id, n, leader): members of the buckets with at least two.

    Of buckets with the same members (told by their number and the sum of their hashes) one is kept.
    """
    rows = cut(sigs.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key")))
    sets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h")).where("n > 1")
    once = sets.groupBy("n", "h").agg(F.min_by(F.struct("key", "leader"), "key").alias("b")).select("b.key", "n", F.col("n").alias("members"), "b.leader")
    return keyed_join(rows, once, ["key"], rows.count()).withColumnRenamed("members", "n")


def _block(n: str) -> Column:
    """The block, of as many as ``n`` members need, that an id falls into."""
    return F.pmod(F.xxhash64("id", F.lit(SEED)), F.ceil(F.col(n) / BLOCK)).cast("int")


def _shell_pairs(near: DataFrame) -> DataFrame:
    """Rows (key, i, j, id, side) from rows (key, id, shell): pairs of blocks of the same shell or neighbouring ones, but not within shell 0."""
    counts = [F.count_if(F.col("shell") == k).alias(f"n{k}") for k in range(SHELLS)]
    sizes = near.groupBy("key").agg(F.count("*").alias("n"), F.array(*[c for c in counts]).alias("sizes")).where(F.col("sizes")[0] < F.col("n"))
    rows = keyed_join(near, sizes, ["key"], near.count())
    blocks = lambda k: F.ceil(F.get("sizes", k) / BLOCK).cast("int")
    own = F.col("shell") * (1 << 24) + F.pmod(F.xxhash64("id", F.lit(SEED)), blocks(F.col("shell"))).cast("int")
    other = lambda k: F.when(blocks(k) > 0, F.transform(F.sequence(F.lit(0), blocks(k) - 1), lambda x: k * (1 << 24) + x)).otherwise(F.array().cast("array<int>"))
    shells = F.filter(F.sequence(F.col("shell") - 1, F.col("shell") + 1), lambda k: (k >= 0) & (k < SHELLS) & ((k > 0) | (F.col("shell") > 0)))
    rows = rows.select("key", "id", own.alias("own"), F.explode(F.flatten(F.transform(shells, other))).alias("other"))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("side"))


def similar(doc: np.ndarray, column: np.ndarray, weight: np.ndarray, n: int, similarity: float) -> np.ndarray:
    """Which pairs of ``n`` texts have a weighted Jaccard similarity of at least ``similarity``, as a matrix.

    A text is a set of layers: one for each shingle and each time that it occurs, so that
    the sum of least weights is a product of matrices.  Layers of one text alone only
    count for its total; the others are taken in runs of ``COLUMNS``.
    """
    total = np.bincount(doc, weights=weight, minlength=n)
    order = np.argsort(column, kind="stable")
    doc, column, weight = doc[order], column[order], weight[order]
    new = np.append(True, column[1:] != column[:-1])
    place = np.cumsum(new) - 1
    shared = np.bincount(place)[place] > 1
    doc, weight, new = doc[shared], weight[shared], new[shared]
    place = np.cumsum(new) - 1
    common = np.zeros((n, n))
    ends = np.searchsorted(place, np.arange(0, (place[-1] + 1 if len(place) else 0) + COLUMNS, COLUMNS))
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if e > s:
            k = place[s:e] - place[s]
            there = np.zeros((n, int(k[-1]) + 1), dtype=np.float32)
            there[doc[s:e], k] = np.sqrt(weight[s:e])
            common += there @ there.T
    return common >= similarity * (total[:, None] + total[None, :] - common) - 1e-6


def _spanning(links: np.ndarray) -> np.ndarray:
    """Edges (x, least of x's component) of a symmetric matrix of links."""
    least = np.arange(len(links))
    while True:
        new = np.minimum(least, np.where(links, least[None, :], len(links)).min(1))
        if (new == least).all():
            break
        least = new
    apart = np.flatnonzero(least != np.arange(len(links)))
    return np.stack([apart, least[apart]], axis=1)


def _layers(text: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text, layer and weight, sorted by the first: a layer is the first time that a shingle occurs, and what each further time adds."""
    row, shingle, weight, tf, base = weighted(text, idf)
    rows, columns, weights = [row], [shingle], [base]
    for k in range(2, int(tf.max(initial=1)) + 1):
        again = tf >= k
        rows.append(row[again])
        columns.append(_mix(shingle[again] + np.uint64(k * int(_P) % (1 << 64))))
        weights.append(base[again] * (np.log(k) - np.log(k - 1)))
    row, column, weight = (np.concatenate(x) for x in (rows, columns, weights))
    order = np.argsort(row, kind="stable")
    return row[order], column[order], weight[order]


def _blocks(rows: DataFrame, done: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``done`` of rows with (key, i, j, side, text), a few whole blocks at a time, and of where in them blocks begin.

    The rows of a block stand together in one partition, in the order of ``side``, the largest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for batch in slices(whole):
                held.append(batch)
                t = pa.Table.from_batches(held)
                key = np.stack([t[k].to_numpy() for k in ("key", "i", "j")])
                starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
                if starts[-1]:  # the last block may go on
                    yield from done(t.slice(0, starts[-1]), starts)
                    held = t.slice(starts[-1]).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            key = np.stack([t[k].to_numpy() for k in ("key", "i", "j")])
            yield from done(t, np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))), t.num_rows))
        held.clear()
        release()

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, rows.count() // 5_000))
    return in_batches(rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("side"))).mapInArrow(run, schema)


def _with_texts(members: DataFrame, texts: DataFrame) -> DataFrame:
    return members.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select("key", "i", "j", "id", "side", "text")


def bucket_links(members: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Edges (a, b) of forests that span the verified links of each pair of blocks of rows (key, i, j, id, side).

    Rows of one side are not compared with each other, but those of side -1 are.
    """

    def done(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        side, ids = t["side"].to_numpy(), t["id"].combine_chunks()
        row, column, weight = _layers(t["text"].combine_chunks(), idf)
        cuts = np.searchsorted(row, starts)
        for k in range(len(starts) - 1):
            s, e = int(starts[k]), int(starts[k + 1])
            if e - s < 2:
                continue
            at = slice(int(cuts[k]), int(cuts[k + 1]))
            links = similar(row[at] - s, column[at], weight[at], e - s, similarity)
            own = side[s:e]
            links &= (own < 0)[:, None] | (own[:, None] != own[None, :])
            edges = _spanning(links)
            if len(edges):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(s + edges[:, j])) for j in (0, 1)], names=["a", "b"])

    kind = members.schema["id"].dataType.simpleString()
    return _blocks(_with_texts(members, texts), done, f"a {kind}, b {kind}")


def shells(members: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Rows (key, id, shell) of members (key, id, n, leader): shell 0 links with the leader, and shells that are no neighbours can't link."""
    blocked = members.select("key", _block("n").alias("i"), _block("n").alias("j"), "id", F.lit(0).alias("side"))
    heads = members.select("key", F.col("leader").alias("id"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).distinct()
    heads = heads.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    heads = heads.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "id", "text").select("key", "i", F.col("i").alias("j"), "id", F.lit(1).alias("side"), "text")

    def done(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, column, weight = _layers(t["text"].combine_chunks(), idf)
        total = np.bincount(row, weights=weight, minlength=t.num_rows)
        cuts = np.searchsorted(row, starts)
        for k in range(len(starts) - 1):
            s, e = int(starts[k]), int(starts[k + 1])
            head = np.sort(column[cuts[k] : np.searchsorted(row, s + 1)])  # the leader comes first
            inner, at = column[cuts[k] : cuts[k + 1]], slice(int(cuts[k]), int(cuts[k + 1]))
            met = head[np.minimum(np.searchsorted(head, inner), len(head) - 1)] == inner if len(head) else np.zeros(len(inner), dtype=bool)
            common = np.bincount(row[at] - s, weights=weight[at] * met, minlength=e - s)
            union = total[s] + total[s:e] - common
            # Links are told as in ``similar``; shells beyond are wider than a link is long.
            linked = common >= similarity * union - 1e-6
            far = 1 - common / np.maximum(union, 1e-12)
            width = 1 - similarity + 1e-3
            shell = np.where(linked, 0, 1 + np.clip(((far - (1 - similarity)) / width).astype(np.int64), 0, SHELLS - 2))
            part = t.slice(s + 1, e - s - 1)
            yield pa.RecordBatch.from_arrays([part["key"].combine_chunks(), part["id"].combine_chunks(), pa.array(shell[1:].astype(np.int32))], names=["key", "id", "shell"])

    kind = members.schema["id"].dataType.simpleString()
    return _blocks(_with_texts(blocked, texts).union(heads.select("key", "i", "j", "id", "side", "text")), done, f"key long, id {kind}, shell int")


def links(members: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Edges (a, b) that connect what the buckets' members (key, id, n, leader) link."""
    small = members.where(F.col("n") <= BLOCK).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", F.lit(-1).alias("side"))
    found = cut(bucket_links(small, texts, idf, similarity))
    large = members.where(F.col("n") > BLOCK)
    if large.isEmpty():
        return found
    near = cut(shells(large, texts, idf, similarity))
    heads = large.select("key", "leader", "n").distinct()
    stars = keyed_join(near.where("shell = 0"), heads, ["key"], near.count()).select(F.col("id").alias("a"), F.col("leader").alias("b")).where("a != b")
    return found.union(stars).union(cut(bucket_links(cut(_shell_pairs(near)), texts, idf, similarity)))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (doc_id, text) for the given ids, once each.

    Ids are broadcast while they are few enough for that; beyond, both sides are shuffled.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    found = docs.select("doc_id", text_of().alias("text")).join(ids, "doc_id", "left_semi")
    return found.groupBy("doc_id").agg(F.any_value("text").alias("text"))


def _vertices(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Adds ``vertex`` to rows with doc_id and h: the id, or where it stands for ``several`` texts (doc_id), a name of id and text."""
    own = F.xxhash64("doc_id", "h") if rows.schema["doc_id"].dataType.simpleString() == "bigint" else F.concat_ws(" ", "doc_id", "h").cast(rows.schema["doc_id"].dataType)
    marked = rows.join(F.broadcast(several) if several.count() <= BROADCAST_IDS else several, "doc_id", "left")
    return marked.withColumn("vertex", F.when(F.col("several"), own).otherwise(F.col("doc_id"))).drop("several")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, h, component_id, kept), one for each row of ``docs``; ``h`` is the digest of its text."""
    hashed = cut(docs.select("doc_id", F.md5(text_of()).alias("h"), F.length(text_of()).alias("l")))
    reps = cut(hashed.where("doc_id is not null").groupBy("h", "l").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    # Ids that stand for several texts: each of these is a vertex of its own, or links of one would be lost.
    several = cut(hashed.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("doc_id", F.lit(True).alias("several")))
    named, plain = docs.where("doc_id is not null").select("doc_id", "text"), several.isEmpty()
    if plain:
        reps = reps.withColumn("vertex", F.col("rep"))
    else:
        named = _vertices(named.withColumn("h", F.md5(text_of())), several).select(F.col("vertex").alias("doc_id"), "text")
        reps = cut(_vertices(reps.withColumnRenamed("rep", "doc_id"), several).withColumnRenamed("doc_id", "rep"))
    idf, rows = document_frequencies(docs)
    sigs = signatures(named, idf).join(reps.select(F.col("vertex").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    members = cut(_buckets(stored(sigs, "signatures")))
    ids = cut(members.select(F.col("id").alias("doc_id")).distinct())
    comp = components(cut(links(members, texts_of(named, ids), idf, similarity)))
    found = reps.join(comp.withColumnRenamed("id", "vertex"), "vertex", "left").select("h", "l", "rep", F.coalesce("component", "vertex").alias("component"), "n")
    if plain:  # a class is named by its smallest id
        found = found.select("h", "l", F.col("component").alias("component_id"), F.when(F.col("rep") == F.col("component"), F.col("h")).alias("first"), "n")
    else:
        found = cut(found)
        least = found.groupBy("component").agg(F.min(F.struct("rep", "h")).alias("least"), F.count("*").alias("n"))
        found = keyed_join(found.withColumnRenamed("n", "copies"), least, ["component"], found.count()).select("h", "l", F.col("least.rep").alias("component_id"), F.col("least.h").alias("first"), F.col("copies").alias("n"))
    out = keyed_join(hashed.where("doc_id is not null"), found, ["h", "l"], rows)
    out = out.select("doc_id", "h", "component_id", ((F.col("doc_id") == F.col("component_id")) & F.coalesce(F.col("h") == F.col("first"), F.lit(False))).alias("kept"))
    return out.union(hashed.where("doc_id is null").select("doc_id", "h", "doc_id", F.lit(True)))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, component_id, kept), one for each row of ``docs``."""
    return classes(docs, similarity).drop("h")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class, the one with the smallest id; of rows that repeat its id and text one stays.

    Texts that share an id are documents of their own; of those in one class the one with the smallest digest stays.
    """
    found = cut(classes(docs).select("doc_id", "h", "kept"))
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    if found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("kept and n > 1").isEmpty():
        ids = kept.select("_id").distinct()  # ids say which rows they are
        return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    own = F.md5(text_of())
    out = docs.join(kept.distinct(), docs["doc_id"].eqNullSafe(F.col("_id")) & (own == F.col("_h")), "left_semi")
    named = out.where("doc_id is not null").withColumn("_h", own).dropDuplicates(["doc_id", "_h"]).drop("_h")
    return named.unionByName(out.where("doc_id is null"))

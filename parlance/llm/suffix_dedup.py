"""Removal of repeated 50-byte strings by suffix arrays built with the difference cover modulo three.

Sorting every suffix of a corpus needs several shuffles of all its bytes.  So texts are first cut
at places that their content chooses, and only what may repeat is sorted:

1. *Sampling.*  Each window of 50 bytes names the smallest hash of its 16-byte grams, its
   anchor.  Equal windows have equal anchors, wherever they stand, so windows need comparing only
   under one anchor.  Neighbouring windows with one anchor are a context of 50 to 84 bytes.
2. *Postings.*  Contexts travel as hashes to the bucket of their anchor.  Equal contexts are
   decided there (a copy in a document of a smaller id removes them), and an anchor that leaves
   different contexts of different documents asks for their bytes.
3. *Suffix arrays.*  Those bytes are grouped by anchor, and each task concatenates the contexts
   of many anchors and sorts their suffixes by the difference-cover algorithm: triples at places
   1 and 2 modulo 3 are sorted and named, names that repeat are sorted by recursion, and the
   remaining suffixes are merged in.  Neighbours in the order that share 50 bytes form a class,
   and a class removes its windows from all documents but the one with its smallest id.

Hot anchors: what a slice of texts holds twice is decided before anything is sent.  Anchors that
``HOT_SHARE`` of a bounded sample of documents have are sent window by window, each under its own
hash, and so are the bytes of anchors with over ``WIDE`` different contexts.  The sample only
chooses this route; both routes give the same rows.

Results for odd input: a null text counts as empty; texts under 50 bytes keep all their bytes.
Documents of a null id neither lose bytes nor make others lose any, and rows of one id do not
count against each other, be they equal or different.  Ties cannot occur, as a class keeps all
windows of its smallest id.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.llm._common import cut, in_batches, release, slices, stored, table, text_of

#: Bytes of a repeated string, and of a gram that may be an anchor.
LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1
#: Windows that are hashed at once, and bytes of text whose contexts are held until they are sent.
PIECE, HELD = 1 << 18, 1 << 22
#: Bytes of text for each bucket of postings.
BUCKET_BYTES = 1 << 23
#: Documents of the sample for hot anchors, the share of them that makes one, and the least number.
SAMPLE_DOCS, HOT_SHARE, HOT_LEAST = 20_000, 0.001, 20
#: Different contexts of an anchor beyond which their windows are grouped one by one; rows up to which ids are broadcast.
WIDE, BROADCAST_IDS = 20_000, 500_000
#: Bytes whose suffixes are sorted together, as long as an anchor's contexts are not more.
SORTED_BYTES = 1 << 16

_ODD = 0x9E3779B97F4A7C15
_PLACES = np.uint64((1 << 20) - 1)
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(1 << 19, _ODD, dtype=np.uint64)))
_INVERSE = np.cumprod(np.append(np.uint64(1), np.full(1 << 19, pow(_ODD, -1, 1 << 64), dtype=np.uint64)))
_BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


# ---- suffix arrays -------------------------------------------------------------------------


def _sorted_triples(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the triples, and which of them, in that order, differ from the one before."""
    n, bits = len(a), int(max(a.max(), b.max(), c.max())).bit_length()
    place = max(1, (n - 1).bit_length())
    if 3 * bits > 63:
        order = np.lexsort((c, b, a))
        x, y = order[1:], order[:-1]
        return order, np.append(True, (a[x] != a[y]) | (b[x] != b[y]) | (c[x] != c[y]))
    key = (((a << bits) | b) << bits) | c
    if 3 * bits + place <= 63:  # the place rides along, and plain numbers sort fastest
        key = np.sort((key << place) | np.arange(n))
        return key & ((1 << place) - 1), np.append(True, np.diff(key >> place) != 0)
    order = np.argsort(key, kind="stable")
    return order, np.append(True, np.diff(key[order]) != 0)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (integers from 1) in their order; a suffix comes before those it begins."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.append(s.astype(np.int64), [0, 0, 0])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # one more where n ends a round, so that the two halves of the names stay apart
    twos = np.arange(2, n, 3)
    sample = np.append(ones, twos)
    order, new = _sorted_triples(t[sample], t[sample + 1], t[sample + 2])
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    ranked = sample[order]
    ranked = ranked[ranked < n]
    # The rest, by first character and the rank of what follows.
    bits = max(int(t.max()).bit_length(), (n + 3).bit_length())
    rest = np.arange(0, n, 3)
    key = (t[rest] << bits) | rank[rest + 1]
    by = np.argsort(key, kind="stable")
    rest, key = rest[by], key[by]
    # How many of the rest come before each sampled suffix: both are told apart by one or two characters and a rank.
    before = np.empty(len(ranked), dtype=np.int64)
    one = ranked % 3 == 1
    j = ranked[one]
    before[one] = np.searchsorted(key, (t[j] << bits) | rank[j + 1])
    j = ranked[~one]
    if 3 * bits <= 63:
        before[~one] = np.searchsorted((((t[rest] << bits) | t[rest + 1]) << bits) | rank[rest + 2], (((t[j] << bits) | t[j + 1]) << bits) | rank[j + 2])
    else:  # pairs are named first
        pairs = (np.append(t[rest], t[j]) << bits) | np.append(t[rest + 1], t[j + 1])
        name = np.unique(pairs, return_inverse=True)[1]
        before[~one] = np.searchsorted((name[: len(rest)] << bits) | rank[rest + 2], (name[len(rest) :] << bits) | rank[j + 2])
    out = np.full(n, -1, dtype=np.int64)
    out[np.arange(len(ranked)) + before] = ranked
    out[out < 0] = rest
    return out


def _repeated(doc: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, count) of the runs of windows that a row of a smaller id has as well."""
    place: dict[bytes, int] = {}
    row = np.array([place.setdefault(c, len(place)) for c in contexts], dtype=np.int64)
    least = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(least, row, doc)
    text = np.frombuffer(b"".join(place), dtype=np.uint8)
    size = np.array([len(c) for c in place], dtype=np.int64)
    end = np.cumsum(size)
    start, owner = end - size, np.repeat(np.arange(len(size)), size)
    fits = np.arange(len(text)) + LENGTH <= end[owner]
    order = suffix_array(text.astype(np.int64) + 1)
    order = order[fits[order]]
    # Neighbours share a prefix of LENGTH bytes if as many words of eight bytes agree, the last one overlapping.
    words = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), dtype=bool)
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        same &= words[a + k] == words[b + k]
    first = np.flatnonzero(np.append(True, ~same))
    keeper = np.empty(len(text), dtype=np.int64)
    keeper[order] = np.repeat(np.minimum.reduceat(least[owner[order]], first), np.diff(np.append(first, len(order))))
    windows = size[row] - LENGTH + 1
    at = np.repeat(np.arange(len(row)), windows)
    offset = np.arange(len(at)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = np.flatnonzero(keeper[start[row[at]] + offset] < doc[at])
    new = np.append(True, (np.diff(hit) != 1) | (np.diff(at[hit]) != 0)) if len(hit) else np.zeros(0, dtype=bool)
    head = np.flatnonzero(new)
    return at[hit[head]], offset[hit[head]], np.diff(np.append(head, len(hit)))


# ---- sampling ------------------------------------------------------------------------------


def _windows(data: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, windows, key, context hash) of the contexts of texts that lie side by side in ``data``."""
    size = np.diff(bounds)
    count = np.maximum(size - LENGTH + 1, 0)
    if not count.sum():
        return tuple(np.zeros(0, dtype=d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data)
    sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * _POWERS[:n], dtype=np.uint64))
    gram = _mix((sums[GRAM:] - sums[:-GRAM]) * _INVERSE[: n - GRAM + 1])
    least = (gram & ~_PLACES) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if SPAN > width:
        least = np.minimum(least[: width - SPAN], least[SPAN - width :])
    row = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + bounds[row]
    anchor = (least[at] & _PLACES).astype(np.int64)
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    many = np.diff(np.append(first, len(at)))
    row, lo, anchor = row[first], at[first], anchor[first]
    key = _mix(gram[anchor] + np.uint64(2))  # anchors are small hashes; buckets take them as evenly spread
    context = _mix(((sums[lo + many + LENGTH - 1] - sums[lo]) * _INVERSE[lo]) ^ _mix((anchor - lo).astype(np.uint64) * np.uint64(101) + many.astype(np.uint64)))
    if len(hot):
        wide = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        if wide.any():
            each = np.repeat(np.flatnonzero(wide), many[wide])
            p = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(many[wide]) - many[wide], many[wide])
            own = _mix(_mix((sums[p + LENGTH] - sums[p]) * _INVERSE[p]) + np.uint64(1))
            apart = _mix(gram[p] * np.uint64(3) ^ _mix(gram[p + GRAM] * np.uint64(5) ^ _mix(gram[p + LENGTH - GRAM] ^ (gram[p + 2 * GRAM] << np.uint64(1)))))
            thin = ~wide
            row, lo, many = np.append(row[thin], row[each]), np.append(lo[thin], p), np.append(many[thin], np.ones(len(p), dtype=np.int64))
            key, context = np.append(key[thin], own), np.append(context[thin], apart)
    return row, lo - bounds[row], many, key, context


def _contexts(part: pa.RecordBatch, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``_windows``, for a slice of rows; a text longer than ``PIECE`` is cut into pieces that overlap by a window."""
    texts = pa.concat_arrays([part["text"].cast(pa.large_binary())])
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if ends[-1] == ends[0]:
        return _windows(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64), hot)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    if len(data) <= 2 * PIECE - LENGTH:
        return _windows(data, ends - ends[0], hot)
    found = []
    for k in range(len(texts)):
        own = data[ends[k] - ends[0] : ends[k + 1] - ends[0]]
        for at in range(0, max(1, len(own) - LENGTH + 1), PIECE):
            piece = own[at : at + PIECE + LENGTH - 1]
            r, lo, *rest = _windows(piece, np.array([0, len(piece)]), hot)
            found.append((r + k, lo + at, *rest))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _hot(rows: DataFrame, docs: int) -> np.ndarray:
    """Anchors of many documents of a sample: SAMPLE_DOCS / HOT_LEAST times the contexts of a document at most."""
    share = min(1.0, SAMPLE_DOCS / max(docs, 1))
    least = max(HOT_LEAST, int(HOT_SHARE * min(docs, SAMPLE_DOCS)))
    none = np.zeros(0, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most_bytes=PIECE):
                row, _, _, key, _ = _contexts(part, none)
                own = np.unique(np.stack([key, row.astype(np.uint64)]), axis=1)[0] if len(key) else key
                key, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])
        release()

    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * share))
    found = in_batches(some.select("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.key for r in found.select("key").collect()], dtype=np.int64).view(np.uint64))


_POSTED = {"key": np.uint32, "context": np.uint64, "doc": np.int64, "tag": np.int32, "lo": np.int32, "many": np.int32}
_POSTINGS = "bucket int, key binary, context binary, doc binary, tag binary, lo binary, many binary"
#: Bytes of a context's hash that travel, besides those of its anchor's.
CONTEXT_BYTES = 6


def _pack(name: str, values: np.ndarray | None, compress) -> bytes | None:
    """A column as bytes: hashes as they are, numbers as differences, byte by byte, and compressed."""
    if values is None:
        return None
    values = values.astype(_POSTED[name])
    if name == "key":
        return values.tobytes()
    if name == "context":
        return values.view(np.uint8).reshape(-1, 8)[:, :CONTEXT_BYTES].tobytes()
    values = np.diff(values, prepend=values.dtype.type(0)) if name == "doc" else values
    return compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _unpack(name: str, packed: pa.Buffer, decompress) -> np.ndarray:
    if name == "key":
        return np.frombuffer(packed, dtype=np.uint32)
    if name == "context":
        raw = np.frombuffer(packed, dtype=np.uint8).reshape(-1, CONTEXT_BYTES)
        out = np.zeros((len(raw), 8), dtype=np.uint8)
        out[:, :CONTEXT_BYTES] = raw
        return out.view(np.uint64)[:, 0]
    kind = np.dtype(_POSTED[name])
    values = np.ascontiguousarray(np.frombuffer(decompress(packed), dtype=np.uint8).reshape(kind.itemsize, -1).T).view(kind)[:, 0]
    return np.cumsum(values) if name == "doc" else values


def _joined_runs(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same windows with neighbouring runs of a document joined."""
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, many = doc[order], tag[order], lo[order], many[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (lo[1:] != lo[:-1] + many[:-1])) if len(doc) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    return doc[first], tag[first], lo[first], np.add.reduceat(many, first) if len(first) else many


def postings(rows: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Packed postings: for each slice and bucket the contexts that the slice itself does not decide; decided ones have no key."""

    def packed(bucket: int, key: np.ndarray | None, context: np.ndarray | None, *rest: np.ndarray) -> dict:
        compress = zstandard.ZstdCompressor(level=1).compress
        return {"bucket": bucket} | {k: _pack(k, v, compress) for k, v in zip(_POSTED, (key, context, *rest), strict=True)}

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, tag, lo, many, key, context = map(np.concatenate, zip(*held, strict=True))
        both = key ^ (context * np.uint64(_ODD))
        order = np.argsort(both)
        first = np.flatnonzero(np.append(True, np.diff(both[order]) != 0)) if len(order) else np.zeros(0, dtype=np.int64)
        behind = np.zeros(len(doc), dtype=bool)
        if len(first):
            behind[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
        out = [packed(int(doc[behind][0]) % buckets, None, None, *_joined_runs(*(c[behind] for c in (doc, tag, lo, many))))] if behind.any() else []
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        left = np.flatnonzero(~behind)
        left = left[np.argsort(bucket[left], kind="stable")]
        for own in np.split(left, np.flatnonzero(np.diff(bucket[left])) + 1) if len(left) else []:
            out.append(packed(int(bucket[own[0]]), (key & np.uint64(0xFFFFFFFF))[own], context[own], doc[own], tag[own], lo[own], many[own]))
        names = ["bucket", *_POSTED]
        kinds = [pa.int32(), *[pa.binary()] * len(_POSTED)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, most_bytes=PIECE):
                row, lo, many, key, context = _contexts(part, hot)
                doc, tag = (part[c].to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, dtype=np.int64) for c in ("doc_id", "tag"))
                held.append((doc, tag, lo, many, key, context))
                size += part["text"].nbytes
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
        release()

    return in_batches(rows.select("doc_id", "tag", "text")).mapInArrow(run, _POSTINGS)


def decided(posted: DataFrame) -> DataFrame:
    """Rows (doc_id, tag, lo, n, gid): windows that go, ``gid`` being null, and windows whose bytes must be compared under ``gid`` (-1: under their own)."""
    out = "doc_id long, tag int, lo int, n int, gid long"

    def answer(number: int, sent: list[tuple[np.ndarray, ...]], gone: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        found = [tuple(map(np.concatenate, zip(*gone, strict=True)))] if gone else []
        gids = [np.full(len(found[0][0]), -2, dtype=np.int64)] if found else []
        if sent:
            key, context, *rest = map(np.concatenate, zip(*sent, strict=True))
            doc = rest[0]
            # Equal contexts: all but those of the smallest id go.
            both = context ^ (key.astype(np.uint64) * np.uint64(_ODD))
            order = np.argsort(both)
            other = np.append(True, np.diff(both[order]) != 0)
            least = np.minimum.reduceat(doc[order], np.flatnonzero(other))
            later = np.zeros(len(doc), dtype=bool)
            later[order] = doc[order] > least[np.cumsum(other) - 1]
            found.append(tuple(c[later] for c in rest))
            gids.append(np.full(int(later.sum()), -2, dtype=np.int64))
            # Different contexts of an anchor and of different documents.
            left = order[~later[order]]
            left = left[np.argsort(key[left], kind="stable")]
            at = np.flatnonzero(np.append(True, np.diff(key[left]) != 0))
            other = np.append(True, (np.diff(key[left]) != 0) | (np.diff(both[left]) != 0))
            kinds = np.add.reduceat(other.astype(np.int64), at)
            asked = (kinds > 1) & (np.minimum.reduceat(doc[left], at) != np.maximum.reduceat(doc[left], at))
            gid = np.where(kinds > WIDE, -1, (np.int64(number) << 32) | key[left[at]].astype(np.int64))
            size = np.diff(np.append(at, len(left)))
            keep = np.repeat(asked, size)
            found.append(tuple(c[left[keep]] for c in rest))
            gids.append(np.repeat(gid, size)[keep])
        doc, tag, lo, many = map(np.concatenate, zip(*found, strict=True))
        gid = np.concatenate(gids)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(lo), pa.array(many), pa.array(gid, mask=gid == -2)], names=["doc_id", "tag", "lo", "n", "gid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        now, sent, gone = None, [], []
        for batch in batches:
            for at, bucket in enumerate(batch["bucket"].to_pylist()):
                if bucket != now and (sent or gone):
                    yield answer(now, sent, gone)
                    sent, gone = [], []
                    release()
                now = bucket
                row = {k: batch[k][at] for k in _POSTED}
                columns = tuple(_unpack(k, v.as_buffer(), decompress) for k, v in row.items() if v.is_valid)
                (sent if row["key"].is_valid else gone).append(columns)
        if sent or gone:
            yield answer(now, sent, gone)
        release()

    return in_batches(posted.repartition("bucket").sortWithinPartitions("bucket")).mapInArrow(run, out)


# ---- bytes ---------------------------------------------------------------------------------


def _packed_texts(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, tag, packed): texts compressed for the way between executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["tag"], pa.array([pack(t) for t in part["text"].cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "tag", "packed"])
        release()

    return in_batches(rows.select("doc_id", "tag", "text")).mapInArrow(run, "doc_id long, tag int, packed binary")


def _by_document(runs: DataFrame, *fields: str) -> DataFrame:
    return runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*fields)).alias("runs"))


def _lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds of a column's lists, and their fields; a null list is empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.append(0, np.cumsum(size)), [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]


def asked_bytes(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (gid, doc_id, tag, lo, context) of the windows that are to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            bounds, (lo, many, gid) = _lists(batch["runs"])
            wide = np.flatnonzero(gid == -1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            if len(wide):  # such contexts are taken apart into windows
                each = np.repeat(wide, many[wide])
                p = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(many[wide]) - many[wide], many[wide])
                thin = gid != -1
                row, lo, many, gid = np.append(row[thin], row[each]), np.append(lo[thin], p), np.append(many[thin], np.ones(len(p), dtype=many.dtype)), np.append(gid[thin], gid[each])
                order = np.argsort(row, kind="stable")
                row, lo, many, gid = row[order], lo[order], many[order], gid[order]
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            pieces: list[bytes] = []
            for k, packed in enumerate(batch["packed"].to_pylist()):
                text = unpack(packed)
                own = slice(bounds[k], bounds[k + 1])
                pieces += [text[a:b] for a, b in zip(lo[own].tolist(), (lo[own] + many[own] + LENGTH - 1).tolist(), strict=True)]
            ids = [pa.array(batch[c].to_numpy(zero_copy_only=False)[row], batch[c].type) for c in ("doc_id", "tag")]
            for at in range(0, len(pieces), 1 << 16):
                own = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(gid[own], pa.int64()), *[c[own] for c in ids], pa.array(lo[own], pa.int32()), pa.array(pieces[own], pa.binary())], names=["gid", "doc_id", "tag", "lo", "context"])
        release()

    joined = texts.join(_by_document(asked, "lo", "n", "gid"), ["doc_id", "tag"])
    found = in_batches(joined).mapInArrow(run, "gid long, doc_id long, tag int, lo int, context binary")
    return found.withColumn("gid", F.when(F.col("gid") == -1, F.xxhash64("context")).otherwise(F.col("gid")))


def compared(contexts: DataFrame) -> DataFrame:
    """Rows (doc_id, tag, lo, n): the windows whose bytes a smaller id has under the same ``gid``."""

    def runs(rows: pa.Table) -> pa.RecordBatch:
        doc = rows["doc_id"].to_numpy()
        row, start, many = _repeated(doc, rows["context"].to_pylist())
        lo = rows["lo"].to_numpy()[row] + start
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(rows["tag"].to_numpy()[row], pa.int32()), pa.array(lo, pa.int32()), pa.array(many, pa.int32())], names=["doc_id", "tag", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = None, 0
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            size += batch["context"].nbytes
            if size < SORTED_BYTES:
                continue
            gid = held["gid"].to_numpy()
            last = int(np.flatnonzero(gid != gid[-1])[-1]) + 1 if gid[0] != gid[-1] else 0  # the last group may go on
            if last:
                yield runs(held.slice(0, last))
                held = held.slice(last).combine_chunks()
                size = held["context"].nbytes
        if held is not None and held.num_rows:
            yield runs(held)
        release()

    return contexts.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, "doc_id long, tag int, lo int, n int")


# ---- whole ---------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows (doc_id, tag, text) with a tag that tells different texts of one id apart, the number of rows and their bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ids = rows.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes"))
    per = cut(ids.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("h").alias("a"), F.max("h").alias("b")))
    several = per.where("a != b and doc_id is not null").select("doc_id", F.lit(True).alias("several"))
    n, size, clashes = per.agg(F.sum("n"), F.sum("bytes"), F.count_if(F.expr("a != b and doc_id is not null"))).first()
    if not clashes:
        return rows.withColumn("tag", F.lit(0)), n or 0, size or 0
    marked = rows.join(F.broadcast(several) if clashes <= BROADCAST_IDS else several, "doc_id", "left")
    return marked.select("doc_id", F.when(F.col("several"), F.pmod(F.xxhash64("text"), F.lit(1 << 31)).cast("int")).otherwise(0).alias("tag"), "text"), n, size


def repeated_windows(rows: DataFrame, docs: int, size: int) -> DataFrame:
    """Rows (doc_id, tag, lo, n) of keyed texts: ``n`` windows from byte ``lo`` on that start in a smaller id as well."""
    named = rows.where("doc_id is not null")
    posted = postings(named, _hot(named, docs), max(8, size // BUCKET_BYTES))
    found = stored(decided(posted), "postings")
    more = compared(asked_bytes(_packed_texts(named), found.where("gid is not null").select("doc_id", "tag", "lo", "n", "gid")))
    return found.where("gid is null").drop("gid").union(more)


def suffix_dedup(docs: DataFrame, whole: bool = True) -> DataFrame:
    """Rows (doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256); ``kept`` has the bytes that stay, if ``whole``."""
    rows, n, size = _keyed(docs)
    marked = _packed_texts(rows).join(_by_document(repeated_windows(rows, n, size), "lo", "n"), ["doc_id", "tag"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            bounds, (lo, many) = _lists(batch["runs"])
            out: list[tuple] = []
            for k, packed in enumerate(batch["packed"].to_pylist()):
                text = unpack(packed)
                own = slice(bounds[k], bounds[k + 1])
                order = np.argsort(lo[own], kind="stable")
                start, end = lo[own][order], np.maximum.accumulate((lo[own] + many[own] + LENGTH - 1)[order])
                first = np.flatnonzero(np.append(True, start[1:] > end[:-1])) if len(start) else np.zeros(0, dtype=np.int64)
                a, b = start[first].tolist(), end[np.append(first[1:] - 1, len(end) - 1)].tolist() if len(first) else []
                kept = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True))
                out.append((kept if whole else None, len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        release()

    return in_batches(marked.select("doc_id", "packed", "runs")).mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), whole=False).drop("kept")


#: Bytes are written in hexadecimal, two characters each, as DuckDB cuts strings but not blobs.
OP13_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {LENGTH - 1}, 0))) AS p FROM d)),
l AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS new FROM w JOIN l USING (s) WHERE doc_id > m),
r AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
k AS (SELECT o.doc_id, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM o JOIN d ON d.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

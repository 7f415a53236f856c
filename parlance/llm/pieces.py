"""SentencePiece encoding and decoding by suffix-array matching.

A text is split into units that no piece crosses.  The new units of a batch are
concatenated; a suffix array over that text (sorted by as many bytes as the longest piece
has) gives every piece's occurrence range by binary search; the occurrences are edges,
which are sorted by position into a table; merges are then relaxed over that table, best
score first and leftmost among equals, as the model's own encoder does.

Results for odd input: a null or empty text has no ids and decodes to the empty text.
Characters without a piece become byte pieces.  Decoding restores a text exactly, but for
U+2581, which the format uses for a space.  Rows are read one by one, so repeated rows get
equal ids; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parlance.llm._common import in_batches, release, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of concatenated units that are indexed at once.
INDEX_BYTES = 1 << 18
#: Units whose ids a task remembers before it starts anew.
CACHE_UNITS = 150_000
#: Units with more characters than this are merged with a heap, the others together.
LONG_UNIT = 48

_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_NONE = 0xFFFF


class PieceCodec:
    """Encoder and decoder for a SentencePiece model of kind BPE with byte fallback, from its file's bytes."""

    def __init__(self, raw: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, model.unk_id(), dtype=np.int32)
        self.bytes_of: list[bytes] = [b""] * n
        plain: list[tuple[float, int, bytes]] = []
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
            elif model.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.bytes_of[i] = name.replace(SPACE, " ").encode()
                plain.append((-model.get_score(i), i, self.bytes_of[i]))
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", self.names[i]) for _, i, _ in plain):
            raise ValueError("a piece crosses the units that texts are split into")
        plain.sort()
        #: A piece's rank is its place by score; ranks stand for pieces in the table of edges.
        self.id_of_rank = np.array([i for _, i, _ in plain], dtype=np.int32)
        self.longest = max(len(b) for *_, b in plain)
        self.width = 8 * -(-self.longest // 8)
        self.rank_len = np.array([len(b) for *_, b in plain], dtype=np.int64)
        pad = lambda fill: np.frombuffer(b"".join(b.ljust(self.width, fill) for *_, b in plain), dtype=">u8").astype(np.uint64).reshape(len(plain), -1)
        self.low, self.high = pad(b"\x00"), pad(b"\xff")
        self.short = self.rank_len <= 8
        places = np.flatnonzero(self.short)
        self.by_low = places[np.argsort(self.low[places, 0], kind="stable")]  # keys in order are found fastest

    def _search(self, windows: np.ndarray, order: np.ndarray, keys: np.ndarray, after: bool) -> np.ndarray:
        """For each key the first place in ``order`` whose suffix is not less (``after``: is greater)."""
        lo, hi = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), len(order), dtype=np.int64)
        for _ in range(len(order).bit_length()):
            mid = np.minimum((lo + hi) >> 1, len(order) - 1)
            at = order[mid]
            less, same = np.zeros(len(keys), dtype=bool), np.ones(len(keys), dtype=bool)
            for j in range(keys.shape[1]):
                w = windows[at + 8 * j]
                less |= same & (w < keys[:, j])
                same &= w == keys[:, j]
            right = (less | (same if after else False)) & (lo < hi)
            lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
        return lo

    def edges(self, data: np.ndarray) -> np.ndarray:
        """All occurrences of pieces in ``data``, sorted by position: words with position, length (8 bits) and rank (16 bits)."""
        n = len(data)
        padded = np.concatenate([data, np.full(self.width + 8, 0xFF, dtype=np.uint8)]).astype(np.uint64)
        windows = np.zeros(n + self.width, dtype=np.uint64)
        for k in range(8):
            windows = (windows << np.uint64(8)) | padded[k : k + n + self.width]
        rank = np.unique(windows, return_inverse=True)[1].astype(np.uint64)
        span = 8
        while span < self.width:  # prefix doubling
            follow = np.concatenate([rank[span:], np.zeros(span, dtype=np.uint64)])
            rank = np.unique((rank << np.uint64(32)) | follow, return_inverse=True)[1].astype(np.uint64)
            span *= 2
        order = np.argsort(rank[:n], kind="stable").astype(np.int32)
        del rank
        # Pieces of up to eight bytes are told apart by one window; longer ones by all of theirs.
        ordered, long = windows[order], ~self.short
        first, last = np.zeros(len(self.short), dtype=np.int64), np.zeros(len(self.short), dtype=np.int64)
        first[self.by_low] = np.searchsorted(ordered, self.low[self.by_low, 0], side="left")
        last[self.by_low] = np.searchsorted(ordered, self.high[self.by_low, 0], side="right")
        first[long], last[long] = self._search(windows, order, self.low[long], False), self._search(windows, order, self.high[long], True)
        count = last - first
        del ordered, windows, padded
        place = np.arange(count.sum(), dtype=np.int32) + np.repeat((first - (np.cumsum(count) - count)).astype(np.int32), count)
        packed = order[place].astype(np.int64) << 24
        del place
        packed |= np.repeat((self.rank_len << 16) | np.arange(len(count)), count)
        packed.sort()
        return packed

    def _merge_long(self, starts: list[int], end: int, table: np.ndarray) -> list[tuple[int, int]]:
        """Symbols (start, length) of one unit after all merges, by a heap."""
        n, ends = len(starts), [*starts[1:], end]
        prev, nxt, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (size := ends[b] - starts[a]) <= self.longest and (r := int(table[starts[a], size])) != _NONE:
                heapq.heappush(heap, (r, a, b, size))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not alive[a] or nxt[a] != b or ends[b] - starts[a] != size:
                continue
            alive[b], ends[a], nxt[a] = False, ends[b], nxt[b]
            if nxt[b] >= 0:
                prev[nxt[b]] = a
            offer(prev[a], a)
            offer(a, nxt[a])
        return [(starts[k], ends[k] - starts[k]) for k in range(n) if alive[k]]

    def _ids(self, data: np.ndarray, table: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols in order of position, and how many each symbol has: its piece's, or those of its bytes."""
        rank = np.where(size <= self.longest, table[start, np.minimum(size, self.longest)], _NONE)
        known = rank != _NONE
        count = np.where(known, 1, size)
        owner = np.repeat(np.arange(len(start)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        by_byte = self.byte_ids[data[start[owner] + nth]]
        return np.where(known[owner], self.id_of_rank[np.minimum(rank, len(self.id_of_rank) - 1)][owner], by_byte), count

    def encode_units(self, units: list[str]) -> list[tuple[int, ...]]:
        """Ids of each unit."""
        raw = [u.replace(SPACE, " ").encode("utf-8", "surrogatepass") for u in units]
        data = np.frombuffer(b"\xff".join(raw) + b"\xff", dtype=np.uint8)
        table = np.full((len(data), self.longest + 1), _NONE, dtype=np.uint16)
        edges = self.edges(data)
        table[edges >> 24, (edges >> 16) & 0xFF] = edges & 0xFFFF
        del edges
        lengths = np.array([len(b) for b in raw], dtype=np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        start = np.flatnonzero(((data & 0xC0) != 0x80) & (data != 0xFF))
        unit = np.searchsorted(begins, start, side="right") - 1
        size = np.minimum(np.append(start[1:], len(data)), (begins + lengths)[unit]) - start
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        long = np.bincount(unit, minlength=len(units)) > LONG_UNIT
        for u in np.flatnonzero(long):
            got = np.array(self._merge_long(start[unit == u].tolist(), int(begins[u] + lengths[u]), table), dtype=np.int64)
            done.append((got[:, 0], got[:, 1], np.full(len(got), u)))
        keep = ~long[unit]
        start, size, unit = start[keep], size[keep], unit[keep]
        while len(start):
            both = size[:-1] + size[1:]
            rank = np.where((unit[:-1] == unit[1:]) & (both <= self.longest), table[start[:-1], np.minimum(both, self.longest)], _NONE)
            key = np.append((rank.astype(np.int64) << 32) | np.arange(len(rank)), _NONE << 32)
            head = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat(key, head)
            more = (best >> 32) != _NONE
            active = np.repeat(more, np.diff(np.append(head, len(unit))))
            done.append((start[~active], size[~active], unit[~active]))
            left = best[more] & 0xFFFFFFFF
            size[left] += size[left + 1]
            active[left + 1] = False
            start, size, unit = start[active], size[active], unit[active]
        start, size, unit = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (start, size, unit)
        by = np.argsort(start, kind="stable")
        ids, count = self._ids(data, table, start[by], size[by])
        cuts = np.cumsum(np.bincount(unit[by], weights=count, minlength=len(units)).astype(np.int64))
        flat, at, out = ids.tolist(), 0, []
        for end in cuts.tolist():
            out.append(tuple(flat[at:end]))
            at = end
        return out

    def units(self, text: str) -> list[str]:
        return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def fill(self, texts: list[list[str]], cache: dict[str, tuple[int, ...]]) -> None:
        """Adds the ids of all units of ``texts`` that ``cache`` lacks."""
        new = list(set().union(*texts) - cache.keys())  # a unit's ids do not depend on what is indexed beside it
        at = 0
        while at < len(new):
            end, total = at, 0
            while end < len(new) and total < INDEX_BYTES:
                total += 3 * len(new[end]) if not new[end].isascii() else len(new[end])
                end += 1
            cache.update(zip(new[at:end], self.encode_units(new[at:end]), strict=True))
            at = end

    def encode(self, texts: list[str], cache: dict[str, tuple[int, ...]] | None = None) -> list[list[int]]:
        cache = {} if cache is None else cache
        split = [self.units(t or "") for t in texts]
        self.fill(split, cache)
        return [list(chain.from_iterable(map(cache.__getitem__, u))) for u in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts before it."""
        out = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


_CODECS: dict[int, PieceCodec] = {}


def model_bytes(path: str = MODEL) -> bytes:
    """A model's file, read on the driver and sent along with a query, so that executors need no copy."""
    with open(path, "rb") as f:
        return f.read()


def codec(raw: bytes | None = None) -> PieceCodec:
    """One codec for each worker process, made anew for another model."""
    raw = model_bytes() if raw is None else raw
    key = hash(raw)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(raw)
    return _CODECS[key]


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Rows (doc_id, ids, round_trip): the ids of each text, and whether decoding gives the text again."""

    raw = model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = codec(raw), {}
        for batch in batches:
            for part in slices(batch):
                if len(cache) > CACHE_UNITS:
                    cache.clear()
                texts = [t or "" for t in part["text"].to_pylist()]
                ids = own.encode(texts, cache)
                same = [own.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(same)], names=["doc_id", "ids", "round_trip"])
                del texts, ids, flat
            release()
        cache.clear()
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids); null ids count as none."""

    raw = model_bytes(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(raw)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [own.decode([] if i is None else list(i)) for i in batch["ids"]]})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")


def _rows(docs: DataFrame) -> DataFrame:
    return encode_documents(docs).selectExpr("doc_id", "cast(size(ids) as bigint) as n_ids", "ids", "round_trip")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(table(spark, sf_dir, "documents"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every document that is left, one row for each copy in the mix."""
    return _rows(docs)

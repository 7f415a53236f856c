"""Fill-in-the-middle transformation with cuts looked up in a compressed set of boundaries.

A text is cut into units, by default lines with their line feeds.  The ends of its units form
a set of integers kept in the manner of Roaring bitmaps: the upper bits of an end name a
container of 2^16 values, which is an array of its lower bits, a bitmap, or a list of runs,
whichever is smallest.  Cumulative cardinalities over the containers tell which one has the
end of rank ``k``; a local select in it, by index, by counted words or by counted runs, gives
the end itself.  Both cuts of a text are answered by one call.

Where to cut and which form to take depends on a salted digest of the id alone, so reruns and
any partitioning agree.  Python finds the offsets; texts are put together and taken apart
again by built-in expressions.

Results for odd input: a null text counts as empty; an empty text and one that holds a marker
stay as they are (form ``plain``).  A null id is hashed as no digits.  Rows are read one by
one, so repeated rows get equal results and ties cannot occur; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parlance.llm._common import in_batches, release, slices, table, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"
SALT = 7
#: Percentages: texts that are transformed, and those of them in suffix-first order.
FIM_PERCENT, SPM_PERCENT = 100, 50
#: Values of a container, and the cardinality up to which an array is not larger than a bitmap.
CHUNK, ARRAY_MOST = 1 << 16, 4096


class ArrayContainer:
    """Sorted lower halves."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """A bit for each value, with the number of bits before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        left, bits = k - int(self.before[word]), int(self.words[word])
        for _ in range(left):
            bits &= bits - 1  # drops the lowest bit
        return 64 * word + (bits & -bits).bit_length() - 1


class RunContainer:
    """Runs of values without a gap, with the number of values before each run."""

    def __init__(self, low: np.ndarray):
        new = np.flatnonzero(np.append(True, np.diff(low) != 1))
        self.start = low[new].astype(np.uint16)
        self.before = np.append(new, len(low))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def _container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three kinds for sorted lower halves."""
    runs = 1 + int((np.diff(low) != 1).sum())
    size = {ArrayContainer: 2 * len(low) if len(low) <= ARRAY_MOST else CHUNK, BitmapContainer: CHUNK // 8, RunContainer: 4 * runs}
    return min(size, key=size.get)(low)


class BoundarySet:
    """A set of non-negative integers with rank lookup; built from sorted values."""

    def __init__(self, values: np.ndarray):
        high = values >> 16
        first = np.flatnonzero(np.append(True, high[1:] != high[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
        self.keys = high[first].tolist()
        self.containers = [_container((part & (CHUNK - 1)).astype(np.int64)) for part in np.split(values, first[1:])] if len(values) else []
        self.before = np.append(first, len(values)).tolist()

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        """The value with ``k`` values before it."""
        at = bisect_right(self.before, k) - 1
        return (self.keys[at] << 16) + self.containers[at].select(k - self.before[at])

    def cuts(self, a: int, b: int) -> tuple[int, int]:
        """Offsets after ``a`` and after ``b`` units."""
        return tuple(self.select(k - 1) if k else 0 for k in (a, b))


def boundaries(text: str) -> BoundarySet:
    """The ends of a text's lines, in code points."""
    codes = np.frombuffer(text.encode("ascii"), dtype=np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.flatnonzero(codes == 10) + 1
    return BoundarySet(np.append(ends, len(codes)) if len(codes) and codes[-1] != 10 else ends)


def _draws(doc_id: Column, salt: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_texts(docs: DataFrame, salt: int = SALT) -> DataFrame:
    """Rows (doc_id, text, n, cut1, cut2, h3, h4): the number of units and both offsets in code points."""
    h1, h2, h3, h4 = _draws(F.col("doc_id"), salt)
    rows = docs.select("doc_id", text_of().alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = []
                for text, x, y in zip(part["text"].to_pylist(), part["h1"].to_pylist(), part["h2"].to_pylist(), strict=True):
                    ends = boundaries(text)
                    n = len(ends)
                    found.append((n, *ends.cuts(*sorted((x % (n + 1), y % (n + 1))))))
                columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text"], *columns, part["h3"], part["h4"]], names=["doc_id", "text", "n", "cut1", "cut2", "h3", "h4"])
            release()

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(rows).mapInArrow(run, f"doc_id {id_kind}, text string, n long, cut1 long, cut2 long, h3 long, h4 long")


def fill_in_middle(docs: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, salt: int = SALT) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output): each text in its form; lengths are null if it is plain."""
    plain = (F.col("text") == "") | F.rlike("text", F.lit(MARKER)) | (F.col("h3") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    a, b = F.col("cut1").cast("int"), F.col("cut2").cast("int")
    prefix, middle = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a)
    suffix = F.substring("text", b + 1, F.length("text"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    only = lambda c: F.when(F.col("form") != "plain", c)
    return cut_texts(docs, salt).withColumn("form", form).select("doc_id", "n", "form", only(F.col("cut1")).alias("prefix_chars"), only(F.col("cut2") - F.col("cut1")).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text that was put into a form, from the output alone; no part of it holds a marker."""
    part = F.split(output, MARKER)
    at = lambda k: F.get(part, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    # An outer explode of one element keeps the output from being made anew for each digest.
    out = out.withColumn("output", F.explode_outer(F.array("output")))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


_SQL_DRAW = ", ".join(f"('0x' || substr(sha256('{SALT}:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, {_SQL_DRAW} FROM documents),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form != 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""

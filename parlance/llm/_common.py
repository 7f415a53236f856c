"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space between words, as a Java/Python character class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters that are not white space."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    own = os.path.join(tempfile.gettempdir(), f"parlance-{uuid.uuid4().hex}")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder."""
    shared = shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet into the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch where the session leaves Spark's own number, so that neither side holds long texts by the thousands.
BATCH_ROWS = 1000
#: A key with more than this share of all rows is joined by broadcast; there are as many such keys at most.
HOT_KEYS, HOT_LEAST = 256, 100


def in_batches(df: DataFrame) -> DataFrame:
    """The same rows; functions over Arrow batches that follow get batches of few rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``most_bytes`` together."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, side="right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def keyed_join(many: DataFrame, one: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``many``, which has ``rows`` rows, joined to ``one``, which has a row for each key and in ``n`` how many of ``many`` it meets.

    The rows of one key all meet in one task.  Keys with over a ``HOT_KEYS``-th of the rows, where
    there are any, are therefore joined by broadcast; they are ``HOT_KEYS`` at most, whatever the
    number of rows.
    """
    least = max(HOT_LEAST, rows // HOT_KEYS)
    found = one.where(F.col("n") > least).collect()
    if not found:
        return many.join(one.drop("n"), keys)
    hot = F.broadcast(many.sparkSession.createDataFrame(found, one.schema))
    met = many.join(hot.drop("n"), keys)
    return met.union(many.join(hot.select(*keys), keys, "left_anti").join(one.where(F.col("n") <= least).drop("n"), keys))


def release() -> None:
    """Gives a worker's freed memory back, as the process may serve other operators after this one."""
    pa.set_memory_pool(pa.system_memory_pool())  # the allocator of the C library, which can be trimmed
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

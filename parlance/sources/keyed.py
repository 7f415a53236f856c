"""Tables with one row for each key, changed in place bucket by bucket (A17, G4, and the sinks of S1 and S3).

Rows lie in ``buckets`` folders by a hash of their key.  A put reads and writes only the buckets
that its keys fall into, each as a new version beside the old one, and then adds the new
versions to a manifest; readers take each bucket's latest version there.  The manifest's append
is the commit: what an unfinished put leaves behind is never read, and a put that is repeated
changes nothing.  One writer at a time; readers need no lock.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

_MANIFEST = "bucket int, version long, folder string"


@dataclass
class KeyedTable:
    """``path`` is a folder that driver and executors share; ``schema`` has the columns, ``keys`` those that name a row."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: Sequence[str]
    buckets: int = 64

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64, newest: str | None = None) -> KeyedTable:
        """A table of the rows; where keys are repeated, as ``put`` says."""
        made = cls(rows.sparkSession, path.rstrip("/"), rows.schema, tuple(keys), buckets)
        rows.sparkSession.createDataFrame([], _MANIFEST).write.mode("overwrite").parquet(f"{made.path}/manifest")
        made.put(rows, newest)
        return made

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _current(self, wanted: list[int] | None = None) -> dict[int, str]:
        """The folder of each bucket; the manifest has a row for each bucket and put, of which the driver sees one for each bucket."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        rows = rows if wanted is None else rows.where(F.col("bucket").isin(wanted))
        return {r.bucket: r.folder for r in rows.groupBy("bucket").agg(F.max_by("folder", "version").alias("folder")).collect()}

    def _read(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/{folder}/_bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows as of now."""
        return self._read(self._current())

    def get(self, wanted: DataFrame) -> DataFrame:
        """The rows of some keys; only the buckets that they fall into are read."""
        keys = wanted.select(*self.keys).distinct()
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
        return self._read(self._current(touched)).join(keys, list(self.keys), "left_semi")

    def put(self, rows: DataFrame, newest: str | None = None) -> list[int]:
        """Replaces the rows of the keys given, and returns the buckets that were written.

        With ``newest`` an older value of that column does not replace a newer one; of equal values the row that is
        put wins over the one that is there.  Of rows put together the newest stays, and of equal ones the largest.
        """
        version_of = {r.bucket: r.version for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").groupBy("bucket").agg(F.max("version").alias("version")).collect()}
        version = max(version_of.values(), default=0) + 1
        new = rows.select(*self.schema.names).withColumn("_bucket", self._bucket())
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
        if not touched:
            return []
        old = self._read(self._current(touched)).withColumn("_bucket", self._bucket())
        every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        order = [F.desc("_new") if newest is None else F.desc(newest), F.desc("_new"), *(F.desc(c) for c in self.schema.names if c not in self.keys)]
        best = every.withColumn("_r", F.row_number().over(Window.partitionBy("_bucket", *self.keys).orderBy(*order))).where("_r = 1").drop("_r", "_new")
        folder = f"data/{version:012d}-{uuid.uuid4().hex}"
        best.repartition(min(len(touched), self.buckets), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        done = [(b, version, folder) for b in touched]
        self.spark.createDataFrame(done, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return touched

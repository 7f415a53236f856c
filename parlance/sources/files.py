"""Files found, named and written: discovery, cache tables, interval grids and audio."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: What marks a transcript that only stands for a recording.
DUMMY = ("@Options:\tdummy", "This is a dummy file to permit playback from the")
GENERATING = ("transcribe", "transcribe_s", "benchmark", "opensmile")


def discovered(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """Rows (path, size) of the files below a folder with one of the extensions, largest first; ``*`` takes all.

    Only names and sizes are read, but for transcripts, whose contents tell dummies, which are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    own = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = files.select("path", F.col("length").alias("size"), own.alias("ext"))
    if "*" not in extensions:
        found = found.where(F.col("ext").isin(*extensions))
    found = found.where("ext != 'cha'").drop("ext").union(_dummies(spark, folder, False)) if {"cha", "*"} & set(extensions) else found.drop("ext")
    return found.orderBy(F.desc("size"), "path")


def _dummies(spark: SparkSession, folder: str, dummy: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][hH][aA]").load(folder)
    text = F.decode("content", "UTF-8")
    is_dummy = F.contains(text, F.lit(DUMMY[0])) | F.contains(text, F.lit(DUMMY[1]))
    return files.where(is_dummy if dummy else ~is_dummy).select("path", F.col("length").alias("size"))


def copied(spark: SparkSession, folder: str, extensions: list[str], command: str) -> DataFrame:
    """Rows (path, size) of the files that a command copies as they are: dummies, and those of other kinds unless it makes new files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))
    if command in GENERATING or "*" in extensions:
        return _dummies(spark, folder, True)
    other = files.where(~F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    return other.union(_dummies(spark, folder, True))


def base_folder(inputs: list[str], is_folder) -> str:
    """The first folder among a call's inputs, else the folder that its files have in common."""
    for x in inputs:
        if is_folder(x):
            return x
    if not inputs:
        return "."
    return os.path.dirname(inputs[0]) if len(inputs) == 1 else os.path.commonpath([os.path.dirname(x) for x in inputs])


def server_names(files: DataFrame, folders: list[str]) -> DataFrame:
    """Adds ``name`` to rows (path): the path below the first folder that holds it, else below what the other files have in common.

    The common folder of those files is found from the least and the greatest of their folders.
    """
    path = F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit("\\"), F.lit("/"))
    rows = files.withColumn("_p", path)
    name: Column | None = None
    for d in folders:
        own = F.startswith("_p", F.lit(d.rstrip("/") + "/"))
        made = F.expr("substring(_p, {})".format(len(d.rstrip("/")) + 2))
        name = F.when(own, made) if name is None else name.when(own, made)
    rows = rows.withColumn("name", name if name is not None else F.lit(None).cast("string"))
    ends = rows.where("name is null").agg(F.min(F.regexp_replace("_p", "[^/]*$", "")), F.max(F.regexp_replace("_p", "[^/]*$", ""))).first()
    common = os.path.commonpath([ends[0], ends[1]]) if ends[0] else "/"
    return rows.withColumn("name", F.coalesce("name", F.expr("substring(_p, {})".format(len(common.rstrip("/")) + 2)))).drop("_p")


def save_cache(cache: DataFrame, path: str) -> None:
    """Writes a result cache as a table partitioned by task; readers of one task read its files alone."""
    cache.write.mode("overwrite").partitionBy("task").parquet(path)


def load_cache(spark: SparkSession, path: str, task: str | None = None) -> DataFrame:
    """A result cache, or one task's part of it."""
    cache = spark.read.parquet(path)
    return cache if task is None else cache.where(F.col("task") == task)


def text_grids(words: DataFrame) -> DataFrame:
    """Rows (f, text): an interval grid of each file from rows (f, speaker, i, word, a, b), times in ms; untimed words are left out.

    Each speaker has a tier; gaps between words are empty intervals.
    """
    s = lambda c: F.format_string("%.3f", c / 1000)
    timed = words.where("a is not null and b > a").groupBy("f", "speaker").agg(F.max("b").alias("end"), F.array_sort(F.collect_list(F.struct("a", "i", "b", "word"))).alias("ws"))
    timed = timed.withColumn("total", F.max("end").over(Window.partitionBy("f")))
    cell = lambda a, b, t: F.struct(a.alias("a"), b.alias("b"), t.alias("t"))
    blank = F.lit("")

    def cells(x: Column, k: Column) -> Column:
        before = F.when(k == 0, 0).otherwise(F.get("ws", k - 1)["b"])
        return F.array_compact(
            F.array(
                F.when(x["a"] > before, cell(before, x["a"], blank)), cell(x["a"], x["b"], F.replace(x["word"], F.lit('"'), F.lit('""'))),
                F.when((k == F.size("ws") - 1) & (x["b"] < F.col("total")), cell(x["b"], F.col("total"), blank)),
            )
        )

    # An explode of one element binds the cells, which are counted and written.
    tiers = timed.select("f", "speaker", "total", F.explode(F.array(F.flatten(F.transform("ws", cells)))).alias("cells"))
    lines = F.transform("cells", lambda x, k: F.concat(F.format_string("        intervals [%d]:\n            xmin = ", k + 1), s(x["a"]), F.lit("\n            xmax = "), s(x["b"]), F.lit('\n            text = "'), x["t"], F.lit('"\n')))
    tiers = tiers.withColumn("n", F.row_number().over(Window.partitionBy("f").orderBy("speaker")))
    body = F.concat(
        F.format_string('    item [%d]:\n        class = "IntervalTier"\n        name = "%s"\n        xmin = 0.000\n        xmax = ', "n", "speaker"), s(F.col("total")),
        F.format_string("\n        intervals: size = %d\n", F.size("cells")), F.array_join(lines, ""),
    )
    out = tiers.select("f", "n", "total", body.alias("body")).groupBy("f").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("n", "body"))).alias("ts"))
    head = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0.000\nxmax = '), s(F.col("total")), F.format_string("\ntiers? <exists>\nsize = %d\nitem []:\n", F.size("ts")))
    return out.select("f", F.concat(head, F.array_join(F.transform("ts", lambda t: t["body"]), "")).alias("text"))


def read_audio(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """Rows (path, n_samples, duration_ms, peak) of files of raw mono little-endian 32-bit floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            samples = [np.frombuffer(x[: len(x) // 4 * 4], dtype="<f4") for x in b["content"]]
            yield pd.DataFrame({"path": b["path"], "n_samples": [len(x) for x in samples], "duration_ms": [len(x) * 1000 // rate for x in samples], "peak": [float(np.abs(x).max(initial=0)) for x in samples]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, n_samples long, duration_ms long, peak double")

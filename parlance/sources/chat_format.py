"""Transcripts as a data source: ``spark.read.format("chat").load(folder)`` (A1, A2).

Rows are lines (file_id, line_idx, kind, key, value) as ``chat.parse_lines`` has them; a schema
given by the reader may name some of these columns only, and then only they are made.  Files are
packed into partitions by size, and each file is read by one task at a time.  Options:

* ``mode``: ``permissive`` (a line of no kind has kind ``error``), ``dropmalformed`` (it is left out), ``failfast`` (it fails the query)
* ``partitionBytes``: bytes of files of a partition, 16 MB unless given; a larger file is a partition of its own
* ``pathGlobFilter``: names of files, ``*.cha`` unless given

Folders are opened by Arrow's file systems (local, HDFS, S3, GCS by the address's scheme), as
planning runs outside of the session; ``chat.read_chat`` reads whatever Spark itself can.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = T.StructType([T.StructField(n, T.IntegerType() if n == "line_idx" else T.StringType()) for n in ("file_id", "line_idx", "kind", "key", "value")])
MODES = ("permissive", "dropmalformed", "failfast")
BATCH_LINES = 4096
_KINDS = {"@": "header", "*": "utterance", "%": "tier"}


def line_of(line: str) -> tuple[str, str | None, str]:
    """Kind, key and value of an unfolded line."""
    kind, (key, tab, value) = _KINDS.get(line[:1], "error"), line[1:].partition(":\t")
    if kind == "error" or kind != "header" and not tab:
        return "error", None, line.partition(":\t")[2] if ":\t" in line else line
    return kind, key, value


def lines_of(text: str) -> list[str]:
    """The lines of a transcript, those that a tab continues in one, without empty ones."""
    return [x for x in re.split(r"\r?\n", re.sub(r"\r?\n\t", " ", text)) if x]


@dataclass
class _Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class ChatReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names = schema.names
        unknown = set(self.names) - set(SCHEMA.names)
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        self.mode = options.get("mode", "permissive").lower()
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if "path" not in options:
            raise ValueError("a path is needed")
        self.root, self.glob = options["path"], options.get("pathglobfilter", options.get("pathGlobFilter", "*.cha"))
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", 16 << 20)))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:/") else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        system, root = self._open()
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size or 0) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.glob))
        out, held, size = [], [], 0
        for path, bytes_ in files:
            if held and size + bytes_ > self.bytes:
                out.append(_Files(held))
                held, size = [], 0
            held.append(path)
            size += bytes_
        return [*out, _Files(held)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = self._open()
        kinds = {"line_idx": pa.int32()}
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = dict(zip(SCHEMA.names, zip(*rows, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.string())) for n in self.names], names=self.names)

        for path in partition.paths:
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            for k, line in enumerate(lines_of(text)):
                kind, key, value = line_of(line)
                if kind == "error" and self.mode == "failfast":
                    raise ValueError(f"not a transcript line: {value[:200]} ({path}, line {k})")
                if kind != "error" or self.mode == "permissive":
                    rows.append((path, k, kind, key, value))
                if len(rows) == BATCH_LINES:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class ChatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ChatReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``format("chat")`` known to a session."""
    spark.dataSource.register(ChatSource)

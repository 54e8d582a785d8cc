"""Byte ranges of large files as rows, so that no row has to hold a whole file."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def local_path(path: str) -> str:
    return path[5:].replace("//", "", 1) if path.startswith("file:") and not path.startswith("file:/") else path.removeprefix("file://").removeprefix("file:")


def files_below(path: str) -> list[tuple[str, int]]:
    path = local_path(path)
    if os.path.isfile(path):
        return [(path, os.path.getsize(path))]
    found = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names]
    return sorted((f, os.path.getsize(f)) for f in found if os.path.isfile(f) and not os.path.islink(f))


class Ranges(InputPartition):
    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = spans


class RangeReader(DataSourceReader):
    """A task reads spans of up to taskSize bytes together, of one large file or of many small ones; with option parallelism less, so that so many tasks get some."""

    def __init__(self, options: dict):
        self.root = local_path(options["path"])
        self.size = int(options.get("rangesize", 8 << 20))
        self.task_size = int(options.get("tasksize", 128 << 20))
        self.task_files = int(options.get("taskfiles", 2000))
        self.parallelism = int(options.get("parallelism", 1))
        self.only = options.get("only", "all")
        self.permissive = options.get("mode") == "permissive"

    def partitions(self) -> list[Ranges]:
        out, now, total = [], [], 0
        files = files_below(self.root)
        whole = sum(n for _, n in files)
        task_size = min(self.task_size, max(1, -(-whole // self.parallelism)))
        task_files = min(self.task_files, max(1, -(-len(files) // self.parallelism))) if len(files) > self.parallelism else self.task_files
        for path, n in files:
            if n and self.only == "empty":
                continue
            for at in range(0, max(n, 1), max(n, 1) if self.only == "names" else self.size):
                part = n if self.only == "names" else min(self.size, n - at)
                if now and (total + part > task_size or len(now) >= task_files):
                    out.append(Ranges(now))
                    now, total = [], 0
                now.append((path, at, part))
                total += part
        return [*out, Ranges(now)] if now else out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        base = self.root if os.path.isdir(self.root) else os.path.dirname(self.root)
        for path, at, n in partition.spans:
            if self.only == "names":
                yield os.path.relpath(path, base), 0, 0, None, n, None
                continue
            data, error = None, None
            try:
                with open(path, "rb") as f:
                    f.seek(at)
                    data = f.read(n)
                if len(data) != n:
                    raise OSError(f"{path} ended {n - len(data)} bytes early at {at}")
            except OSError as e:
                if not self.permissive:
                    raise
                data, error = None, str(e)
            yield os.path.relpath(path, base), at // self.size, at, data, n, error


class ByteRanges(DataSource):
    """spark.read.format('byte_ranges').option('rangeSize', n).load(path): chunks of all files below a path.

    Option only: 'empty' for empty files alone, 'names' for one row a file with its size and without its bytes.  Option mode: a range
    that can't be read fails the job, or with 'permissive' has no data and its column error says why.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "relative_path string, chunk_seq int, fdata_offset bigint, data binary, uncompressed_size bigint, error string"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ByteRanges)

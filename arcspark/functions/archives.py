"""ZIP and tar contents as rows, and decompression helpers for plugin functions."""

from __future__ import annotations

import bz2
import errno
import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opened(data: bytes | BinaryIO) -> BinaryIO:
    """The bytes as a file; an open file is taken as it is."""
    return data if hasattr(data, "read") else io.BytesIO(data)


def unreadable(e: Exception) -> bool:
    """Whether the file itself can't be read, rather than its contents being broken (which may also seek to nowhere)."""
    return isinstance(e, OSError) and e.errno not in (None, errno.EINVAL)


def zip_find(data: bytes | BinaryIO, needle: str = "") -> Iterator[tuple[str, bytes]]:
    """Entries of a ZIP whose name contains needle; only those are inflated.  Broken archives give what can be read."""
    try:
        with zipfile.ZipFile(opened(data)) as z:
            for info in z.infolist():
                if needle in info.filename and not info.is_dir():
                    try:
                        yield info.filename, z.read(info)
                    except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, RuntimeError):
                        continue
    except (zipfile.BadZipFile, EOFError, ValueError, OSError) as e:
        if unreadable(e):
            raise


def tar_find(data: bytes, needle: str = "") -> Iterator[tuple[str, bytes]]:
    """Regular files of a plain, gzip or bzip2 tarball whose name contains needle."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for member in t:
                if member.isfile() and needle in member.name:
                    yield member.name, t.extractfile(member).read()
    except (tarfile.TarError, EOFError, OSError, zlib.error):
        return


def expand(data: bytes, kind: str) -> bytes | None:
    """Bytes of a deflate, gzip, bzip2 or zstd stream, or None if it can't be decoded."""
    try:
        if kind == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
        return {"deflate": lambda d: zlib.decompress(d, -15), "gzip": gzip.decompress, "bzip2": bz2.decompress}[kind](data)
    except (OSError, EOFError, ValueError, zlib.error):
        return None
    except Exception as e:
        if type(e).__name__ == "ZstdError":
            return None
        raise


def entries(files: DataFrame, kind: str = "zip", needle: str = "") -> DataFrame:
    """(relative_path, name, data): contents of archives in rows (relative_path, content); kind is zip or tar."""
    find = {"zip": zip_find, "tar": tar_find}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                # One archive at a time, so that memory holds one archive's wanted entries.
                found = list(find(content.as_py() or b"", needle))
                if found:
                    names, data = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(names)), pa.array(names), pa.array(data, pa.binary())], ["relative_path", "name", "data"])

    return files.select("relative_path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "relative_path string, name string, data binary")

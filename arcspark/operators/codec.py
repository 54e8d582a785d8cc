"""Chunks to blobs and back: checksum, compression, decoding and verification in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

LEVEL = 19
HASHES: dict[str, Callable[[bytes], bytes]] = {"sha256": lambda b: hashlib.sha256(b).digest(), "blake2b-256": lambda b: hashlib.blake2b(b, digest_size=32).digest()}


def hasher(name: str) -> Callable[[bytes], bytes]:
    """The checksum of that name; an archive whose algorithm is missing here raises instead of looking corrupt."""
    if name == "blake3":
        try:
            import blake3
        except ImportError as e:
            raise ValueError("this archive needs BLAKE3, which isn't installed") from e
        return lambda b: blake3.blake3(b).digest()
    if name not in HASHES:
        raise ValueError(f"unknown checksum {name}")
    return HASHES[name]


def encode(chunks: DataFrame, level: int = LEVEL, algorithm: str = "sha256") -> DataFrame:
    """Chunks (data, compressed, ...) with checksum, blob and blob_size; where compressed is false the bytes stay as they are."""
    hasher(algorithm)
    schema = StructType([*(f for f in chunks.schema if f.name != "data"), StructField("checksum", BinaryType()), StructField("blob", BinaryType()), StructField("blob_size", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, packer = hasher(algorithm), zstandard.ZstdCompressor(level=level)
        for b in batches:
            data, flag = b.column("data"), b.column("compressed")
            sums, blobs = [], []
            for d, c in zip(data, flag):
                raw = d.as_buffer() if hasattr(d, "as_buffer") and d.is_valid else b""
                sums.append(own(raw))
                blobs.append(packer.compress(raw) if c.as_py() else bytes(raw))
            rest = [b.column(f.name) for f in schema.fields[:-3]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sums, pa.binary()), pa.array(blobs, pa.binary()), pa.array([len(x) for x in blobs], pa.int64())], [f.name for f in schema])

    return chunks.mapInArrow(run, schema)


def decode(rows: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Rows (blob, compressed, checksum, uncompressed_size, ...) with data and status: ok, corrupt or undecodable."""
    hasher(algorithm)
    schema = StructType([*(f for f in rows.schema if f.name != "blob"), StructField("data", BinaryType()), StructField("status", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, unpacker = hasher(algorithm), zstandard.ZstdDecompressor()
        for b in batches:
            data, status = [], []
            for blob, c, want, size in zip(*(b.column(n).to_pylist() for n in ("blob", "compressed", "checksum", "uncompressed_size"))):
                try:
                    raw = unpacker.decompress(blob, max_output_size=max(size or 0, 1)) if c else blob
                except (zstandard.ZstdError, TypeError):
                    raw = None
                data.append(raw)
                status.append("undecodable" if raw is None else "ok" if own(raw) == want else "corrupt")
            rest = [b.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(data, pa.binary()), pa.array(status)], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def verify_report(status: DataFrame) -> DataFrame:
    """One row over (relative_path, status, uncompressed_size): files, bytes, chunks.

    corrupt_files counts corrupt chunks and verified_files what then remains of the files, as the format's
    report does; corrupt_files_distinct counts files.  Undecodable chunks count as chunks only.
    """
    size = F.col("uncompressed_size")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, size)), F.lit(0)).cast("bigint")
    by = status.groupBy("relative_path").agg(F.count_if(F.col("status") == "corrupt").alias("bad"), F.count("*").alias("n"), of("ok").alias("ok"), of("corrupt").alias("corrupt"), F.sum(size).alias("size"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    one = by.agg(F.count("*").alias("total_files"), zero("bad").alias("corrupt_files"), F.count_if(F.col("bad") > 0).alias("corrupt_files_distinct"), zero("size").alias("total_bytes"), zero("ok").alias("verified_bytes"), zero("corrupt").alias("corrupt_bytes"), zero("n").alias("chunks"))
    return one.withColumn("verified_files", F.greatest(F.col("total_files") - F.col("corrupt_files"), F.lit(0)))

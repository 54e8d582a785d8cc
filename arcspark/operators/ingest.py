"""From entries to chunks: skip rule, slicing, checksums, offsets, groups, manifest and report.

Entries are rows (relative_path, content, pkg_type, repo).  Null groups are untyped: package type 0,
repository ''.  A null content counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SLICE = 8 << 20
#: Extensions of files that are stored as they are.  The archive's own extension is a parameter of skip_flag.
STORED = (
    "zip", "gz", "bz2", "xz", "lz", "lzma", "7z", "rar", "cab", "jar", "war", "ear", "zst", "sz", "lz4", "tgz", "txz", "tbz",
    "apk", "dmg", "deb", "rpm", "arrow", "mpeg", "mpg", "jpeg", "jpg", "gif", "bmp", "png", "crate", "zdata", "parquet", "webp", "webm",
)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name, lower case; a leading dot alone makes no extension."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]+)/*$", 1), r"(?s)^.+\.([^.]*)$", 1))


def skip_flag(path: Column, no_skip: bool = False, own: tuple[str, ...] = ()) -> Column:
    """Whether a file is stored as it is."""
    if no_skip:
        return F.lit(False)
    return F.coalesce(extension(path).isin(*STORED, *own), F.lit(False))


def untyped(df: DataFrame) -> DataFrame:
    """Groups with null as 0 and ''; columns that lack are added."""
    for name, kind, value in (("pkg_type", "tinyint", 0), ("repo", "string", "")):
        own = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        df = df.withColumn(name, F.coalesce(own, F.lit(value).cast(kind)))
    return df


def slices(entries: DataFrame, size: int = SLICE) -> DataFrame:
    """One row for each piece of size bytes of an entry, at least one for an empty entry."""
    entries = untyped(entries).withColumn("content", F.coalesce("content", F.lit(b"")))
    length = F.octet_length("content").cast("bigint")
    last = F.floor(F.greatest(length - 1, F.lit(0)) / size)
    # The pieces are cut before they are exploded: a row carries its own bytes and never the whole content.
    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.substring("content", (i * size + 1).cast("int"), F.lit(size)))
    rest = [c for c in entries.columns if c != "content"]
    rows = entries.select(*rest, "content", length.alias("file_size")).select(*rest, "file_size", F.posexplode(pieces).alias("chunk_seq", "data"))
    return rows.select(*rest, "file_size", "chunk_seq", (F.col("chunk_seq").cast("bigint") * size).alias("fdata_offset"), "data", F.octet_length("data").cast("bigint").alias("uncompressed_size"))


def checksum(data: Column) -> Column:
    """SHA-256 of the original bytes, 32 bytes wide."""
    return F.unhex(F.sha2(data, 256))


def crc(data: Column) -> Column:
    """CRC-32 of the bytes, unsigned; the check that ZIP and gzip use, not one of the archive's checksums."""
    return F.crc32(data)


def prefix_sum(df: DataFrame, order: list[str], size: Column, out: str, start: int = 0) -> DataFrame:
    """df with the exclusive running sum of size in the given order.

    Two levels, so that no single task orders everything: rows are spread by range, each range sums its own
    rows, and only the ranges' totals (one row for each range) are ordered as a whole.
    """
    ranged = materialize(df.withColumn("__size", size.cast("bigint")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    before = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(F.sum("__size").alias("__total"))
    base = totals.select("__part", F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = ranged.withColumn("__inner", F.coalesce(F.sum("__size").over(before("__part")), F.lit(0)))
    return inner.join(F.broadcast(base), "__part").withColumn(out, F.col("__base") + F.col("__inner") + start).drop("__part", "__size", "__total", "__base", "__inner")


def positions(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """df with the 0-based rank in the given order, found in two levels."""
    return prefix_sum(df, order, F.lit(1), out)


def blob_layout(chunks: DataFrame, order: tuple[str, ...] = ("relative_path", "chunk_seq")) -> DataFrame:
    """Chunks with blob_offset: blobs lie without gaps from 0, in order of path and chunk."""
    return prefix_sum(chunks, list(order), F.col("blob_size"), "blob_offset")


def manifest(index: DataFrame) -> DataFrame:
    """One row for each group: index rows, files, bytes; in ascending order of the group."""
    rows = untyped(index).groupBy("pkg_type", "repo", "relative_path").agg(F.count("*").alias("n"), F.sum("uncompressed_size").alias("size"))
    return rows.groupBy("pkg_type", "repo").agg(F.sum("n").alias("row_count"), F.count("*").alias("files"), F.sum("size").alias("total_bytes"))


def manifest_rollup(index: DataFrame) -> DataFrame:
    """Rows and bytes by group, by package type and in all."""
    return untyped(index).rollup("pkg_type", "repo").agg(F.count("*").alias("row_count"), F.sum("uncompressed_size").alias("total_bytes"))


def big_small(files: DataFrame, slice_size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Files read in slices (larger than one, or empty) and files read whole."""
    big = (F.col("file_size") > slice_size) | (F.col("file_size") == 0)
    return files.where(big), files.where(~big)


def compression_report(index: DataFrame) -> DataFrame:
    """One row: files and bytes stored and compressed, chunks, and both ratios the formats know.

    ratio_stream is compressed input over output less stored bytes, ratio_dir compressed input over all output, 0 where nothing was
    stored; ratio is plain input over output.
    """
    by = index.groupBy("relative_path").agg(F.bool_or("compressed").alias("c"), F.sum(F.when(F.col("compressed"), F.col("uncompressed_size")).otherwise(0)).alias("cb"), F.sum(F.when(~F.col("compressed"), F.col("uncompressed_size")).otherwise(0)).alias("ub"), F.sum("blob_size").alias("out"), F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    one = by.agg(
        F.count("*").alias("total_files"), F.count_if("c").alias("compressed_files"), F.count_if(~F.col("c")).alias("uncompressed_files"),
        zero(F.sum("n")).alias("chunks"), zero(F.sum("cb")).alias("compressed_bytes"), zero(F.sum("ub")).alias("uncompressed_bytes"), zero(F.sum("out")).alias("total_bytes_out"),
    )
    cb, ub, out = F.col("compressed_bytes"), F.col("uncompressed_bytes"), F.col("total_bytes_out")
    return one.select(
        "*", (cb + ub).alias("total_bytes_in"),
        F.when((cb > 0) & (out > ub), cb / (out - ub) * 100).otherwise(0.0).alias("ratio_stream"),
        F.when(ub > 0, cb / F.greatest(out, F.lit(1)) * 100).otherwise(0.0).alias("ratio_dir"),
        F.when(out > 0, (cb + ub) / out).otherwise(0.0).alias("ratio"),
    )


def attach(index: DataFrame, extension_rows: DataFrame, key: str = "relative_path") -> DataFrame:
    """Index rows with their file's extension columns, null where there are none."""
    return index.join(extension_rows, key, "left")

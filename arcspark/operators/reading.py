"""Views of an index: listing, files, sizes, reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest file that is put together in a row.
MAX_CONTENT = 1 << 30


def listing(index: DataFrame) -> DataFrame:
    """One row for each file: path, size of its first chunk, and its coordinate where it has a group_id."""
    first = index.where("chunk_seq = 0")
    gav = F.lit(None).cast("string")
    if {"group_id", "artifact_id", "version"} <= set(index.columns):
        gav = F.when(F.col("group_id").isNotNull(), F.concat("group_id", F.lit(":"), F.coalesce("artifact_id", F.lit("")), F.lit(":"), F.coalesce("version", F.lit(""))))
    text = F.concat_ws("\t", "relative_path", F.col("uncompressed_size").cast("string"), gav)
    return first.select("relative_path", F.col("uncompressed_size").alias("chunk0_size"), gav.alias("gav"), text.alias("line"))


def files(index: DataFrame) -> DataFrame:
    return index.select("relative_path").distinct()


def rollup(index: DataFrame) -> DataFrame:
    """(relative_path, file_size, chunks): all sizes summed by mergeable aggregates."""
    return index.groupBy("relative_path").agg(F.sum("uncompressed_size").alias("file_size"), F.count("*").alias("chunks"))


def entries(index: DataFrame) -> DataFrame:
    """Each file with its chunk list in order of offset; a row holds the chunks of one file."""
    chunk = F.struct("fdata_offset", "chunk_seq", "uncompressed_size", "blob_offset", "blob_size", "compressed")
    return index.groupBy("relative_path").agg(F.sum("uncompressed_size").alias("file_size"), F.array_sort(F.collect_list(chunk)).alias("chunk_list"))


def reassemble(decoded: DataFrame) -> DataFrame:
    """(relative_path, content): chunks of a file concatenated in order of offset.

    A row holds a whole file, so one of more than MAX_CONTENT bytes raises; such files are extracted to a folder, chunk by chunk.
    """
    whole = decoded.groupBy("relative_path").agg(F.expr("listagg(data) within group (order by fdata_offset, chunk_seq)").alias("content"), F.sum(F.octet_length("data").cast("bigint")).alias("bytes"))
    large = F.raise_error(F.concat(F.lit("too large for one row: "), "relative_path"))
    return whole.select("relative_path", F.when(F.col("bytes") > MAX_CONTENT, large.cast("binary")).otherwise(F.col("content")).alias("content"))

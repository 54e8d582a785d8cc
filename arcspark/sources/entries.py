"""Entries from folders, tables and single values."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges

ENTRY = "relative_path string, content binary, pkg_type tinyint, repo string"


def _root(spark: SparkSession, path: str) -> str:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    # A pattern's root is the folder before it, a file's root its folder.
    while set("*?[{") & set(p.toString()) or fs.isFile(p):
        p = p.getParent()
    return fs.makeQualified(p).toString()


def relative(spark: SparkSession, path: str) -> Column:
    root = _root(spark, path).rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    own = plain(F.col("path"))
    return F.substr(own, F.lit(len(root.replace("file:///", "file:/").replace("file://", "file:")) + 1))


def _empty(spark: SparkSession, path: str) -> DataFrame:
    """Paths of empty files, which Spark's own file source passes over."""
    ranges.register(spark)
    return spark.read.format("byte_ranges").option("only", "empty").load(path).select("relative_path")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(relative_path, file_size) of all regular files below a folder; contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(relative(spark, path).alias("relative_path"), F.col("length").alias("file_size")).unionByName(_empty(spark, path).withColumn("file_size", F.lit(0).cast("bigint")))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(relative_path, file) of all files that the range source reads, whatever their size; file is where executors open it."""
    ranges.register(spark)
    root = os.path.abspath(ranges.local_path(path))
    base = os.path.dirname(root) if os.path.isfile(root) else root
    return spark.read.format("byte_ranges").option("only", "names").load(path).select("relative_path", F.concat(F.lit(base.rstrip("/") + "/"), "relative_path").alias("file"))


def from_dir(spark: SparkSession, path: str, pkg_type: int | None = None, repo: str | None = None, max_size: int | None = None) -> DataFrame:
    """Entries of a folder's files up to max_size bytes; larger ones are for the range source."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_size is not None:
        raw = raw.where(F.col("length") <= max_size)
    files = raw.select(relative(spark, path).alias("relative_path"), "content").unionByName(_empty(spark, path).withColumn("content", F.lit(b"")))
    return files.select("relative_path", "content", F.lit(pkg_type).cast("tinyint").alias("pkg_type"), F.lit(repo).cast("string").alias("repo"))


def entry(spark: SparkSession, path: str, content: bytes, pkg_type: int | None = None, repo: str | None = None) -> DataFrame:
    return spark.createDataFrame([(path, bytearray(content), pkg_type, repo)], ENTRY)


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as entries: '<source>/<doc_id>.txt', their text in UTF-8, the source as repository."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("relative_path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), F.lit(None).cast("tinyint").alias("pkg_type"), F.col("source").alias("repo"))



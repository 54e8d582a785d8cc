"""Where an archive's index and blobs go: tables, or one file."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packages import table_name
from ..operators.ingest import untyped
from ..schema import widen
from . import container


#: Groups up to which their names are broadcast to the index.
MAX_GROUPS = 100_000


class Sink(Protocol):
    def write(self, index: DataFrame, blobs: DataFrame | None = None) -> int: ...


class TableSink:
    """One table for each group in a namespace, named after the group; write returns the bytes they take.

    All groups are written by one job, into a folder for each, and the tables are registered over these folders; a large group is
    split over tasks.  Where a catalog keeps its own files (format='iceberg') each table is written by itself.
    """

    FILES = ("parquet", "orc")

    def __init__(self, spark: SparkSession, namespace: str, format: str = "parquet", module: str = "", location: str | None = None):
        """location: a shared folder for the tables' files; by default the warehouse's."""
        self.spark, self.namespace, self.format, self.module, self.location = spark, namespace, format, module, location

    def names(self, index: DataFrame) -> DataFrame:
        groups = untyped(index).select("pkg_type", "repo").distinct().orderBy("pkg_type", "repo").collect()  # one row a table
        rows = [(g["pkg_type"], g["repo"], self.module, i) for i, g in enumerate(groups)]
        df = self.spark.createDataFrame(rows, "pkg_type tinyint, repo string, module_name string, nth int")
        return df.withColumn("table", table_name(F.col("pkg_type"), F.col("repo"), F.col("module_name"), F.col("nth")))

    def write(self, index: DataFrame, blobs: DataFrame | None = None) -> int:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.namespace}`")
        names = self.names(index).collect()
        if not names:
            raise ValueError("there is nothing to write")
        own = widen(untyped(index))
        if self.format in self.FILES:
            return self._files(own, names)
        total = 0
        for g in names:
            full = f"`{self.namespace}`.`{g['table']}`"
            part = own.where((F.col("pkg_type") == g["pkg_type"]) & (F.col("repo") == g["repo"]))
            out = part.write.mode("overwrite").format(self.format)
            (out.option("path", f"{self.location}/{g['table']}") if self.location else out).saveAsTable(full)
            place = self.spark.sql(f"DESCRIBE FORMATTED {full}").where("col_name = 'Location'").first()["data_type"]
            total += size_of(self.spark, place)
        return total


    def _files(self, own: DataFrame, names: list) -> int:
        spark, root = self.spark, self.location or f"{self.spark.conf.get('spark.sql.warehouse.dir')}/{self.namespace}.db/groups"
        named = spark.createDataFrame([(g["pkg_type"], g["repo"], g["table"]) for g in names], "pkg_type int, repo string, group_table string")
        rows = own.join(F.broadcast(named) if len(names) <= MAX_GROUPS else named, ["pkg_type", "repo"]).select(*own.columns, "group_table")
        rows.hint("rebalance", "group_table").write.mode("overwrite").format(self.format).partitionBy("group_table").save(root)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
        for g in names:
            full = f"`{self.namespace}`.`{g['table']}`"
            spark.sql(f"DROP TABLE IF EXISTS {full}")
            spark.sql(f"CREATE TABLE {full} ({columns}) USING {self.format} LOCATION '{root}/group_table={g['table']}'")
        return size_of(spark, root)


class ContainerSink:
    """One file with blobs, group indexes and manifest; write returns its length."""

    def __init__(self, path: str, mark: bytes = container.MARK, module: str = "", extension: str | None = None):
        self.path = path if extension is None or path.endswith(extension) else path + extension
        self.mark, self.module = mark, module

    def write(self, index: DataFrame, blobs: DataFrame | None = None) -> int:
        rows = untyped(index) if blobs is None else untyped(index).join(blobs.select("relative_path", "chunk_seq", "blob"), ["relative_path", "chunk_seq"])
        return container.write(rows, self.path, self.mark, self.module)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path; contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return int(raw.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])

"""Entries from a stream into an archive; the manifest appears when the stream is finished."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..plans import archive
from ..sources import entries

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def files(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of entries: files as they appear below a folder, by their paths relative to it.  Spark's file stream passes over empty files."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if per_trigger:
        raw = raw.option("maxFilesPerTrigger", per_trigger)
    return raw.load(path).select(entries.relative(spark, path).alias("relative_path"), "content", F.lit(None).cast("tinyint").alias("pkg_type"), F.lit(None).cast("string").alias("repo"))


class Ingest:
    """A running ingest.  Each micro-batch writes a folder of its own, so a batch that is repeated replaces itself."""

    def __init__(self, stream: DataFrame, out: str, no_skip: bool = False, slice_size: int = ingest.SLICE, level: int = 3, available_now: bool = True):
        self.spark, self.out = stream.sparkSession, out

        def put(batch: DataFrame, batch_id: int) -> None:
            archive.encode(batch, no_skip, slice_size, level).write.mode("overwrite").parquet(f"{out}/blobs/batch={batch_id}")

        writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/_progress")
        self.query = (writer.trigger(availableNow=True) if available_now else writer).start()

    def finish(self) -> DataFrame:
        """Wait for the end, publish index and manifest, return the report."""
        self.query.awaitTermination()
        if self.query.exception():
            raise self.query.exception()
        return publish(self.spark, self.out)


def publish(spark: SparkSession, out: str) -> DataFrame:
    """Index and manifest of all batches written so far; publishing again gives the same.

    Both are written into a folder of their own, and readers see it (published) once a mark with its name is moved into place: they get the old index
    and manifest, or the new ones, never one of each.
    """
    name = uuid.uuid4().hex
    own = f"{out}/published/{name}"
    ingest.blob_layout(spark.read.parquet(f"{out}/blobs").drop("blob", "batch")).write.parquet(f"{own}/index")
    index = spark.read.parquet(f"{own}/index")
    ingest.manifest(index).coalesce(1).write.parquet(f"{own}/manifest")
    fs, path = _files(spark, out)
    nth = max(_marks(spark, out), default=-1) + 1
    fs.create(path(f"{out}/published/_{name}")).close()
    if not fs.rename(path(f"{out}/published/_{name}"), path(f"{out}/published/{nth:010d}-{name}")):
        raise OSError(f"{out} could not be published")
    return ingest.compression_report(index)


def _files(spark: SparkSession, out: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(out).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _marks(spark: SparkSession, out: str) -> dict[int, str]:
    """Number and folder of everything that was published."""
    fs, path = _files(spark, out)
    root = path(f"{out}/published")
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return {int(n[:10]): n[11:] for n in names if n[:10].isdigit() and n[10:11] == "-"}


def published(spark: SparkSession, out: str, table: str = "index") -> DataFrame:
    """The index or manifest that was published last."""
    marks = _marks(spark, out)
    if not marks:
        raise ValueError(f"nothing is published in {out}")
    return spark.read.parquet(f"{out}/published/{marks[max(marks)]}/{table}")

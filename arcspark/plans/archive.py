"""An archive as tables in a folder: write entries, open, list, extract, verify."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import codec, ingest, reading
from ..operators.plugins import Plugin, Registry
from ..schema import INDEX
from ..session import counted, materialize
from ..sources import entries as sources
from ..sources import ranges
from ..sources.ranges import local_path

GROUP = ["pkg_type", "repo"]
#: Paths that are broadcast up to so many.
MAX_LOOKUP = 200_000


def encode(entries: DataFrame, no_skip: bool = False, slice_size: int = ingest.SLICE, level: int = codec.LEVEL, algorithm: str = "sha256") -> DataFrame:
    """Entries to encoded chunks: sliced, hashed, compressed or stored."""
    own = ingest.slices(entries, slice_size).withColumn("compressed", ~ingest.skip_flag(F.col("relative_path"), no_skip))
    return codec.encode(own.select("relative_path", "chunk_seq", "fdata_offset", "compressed", "uncompressed_size", *GROUP, "data"), level, algorithm)


def _last(entries: DataFrame, order: str) -> DataFrame:
    """Of entries with one path the one with the largest order; only paths that repeat are joined."""
    again, rows = counted(entries.groupBy("relative_path").agg(F.max(order).alias("__last"), F.count("*").alias("__n")).where("__n > 1").select("relative_path", "__last"), "again")
    if not rows:
        return entries
    again = F.broadcast(again) if rows <= MAX_LOOKUP else again
    return entries.join(again, "relative_path", "left").where(F.col("__last").isNull() | (F.col(order) == F.col("__last"))).drop("__last")


def _once(index: DataFrame) -> None:
    """Raises if two entries have one path, which would be read back as one file."""
    twice = index.groupBy("relative_path", "chunk_seq").agg(F.count("*").alias("n")).where("n > 1").select("relative_path").limit(3).collect()
    if twice:
        raise ValueError(f"several entries have one path: {', '.join(sorted({str(r[0]) for r in twice}))}")


def _readable(blobs: DataFrame, out: str) -> DataFrame:
    """Leave out the files of which a range couldn't be read (column error), and list them in out/errors."""
    spark = blobs.sparkSession
    bad, rows = counted(blobs.where("error is not null").groupBy("relative_path").agg(F.min("error").alias("error")), "errors")
    bad.write.mode("overwrite").parquet(f"{out}/errors")
    if rows:
        kept = blobs.join(F.broadcast(bad.select("relative_path")) if rows <= MAX_LOOKUP else bad.select("relative_path"), "relative_path", "left_anti")
        kept.write.mode("overwrite").option("compression", "uncompressed").option("parquet.enable.dictionary#blob", "false").parquet(f"{out}/blobs-readable")
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(path(f"{out}/blobs"), True)
        fs.rename(path(f"{out}/blobs-readable"), path(f"{out}/blobs"))
    return bad


def _put(encoded: DataFrame, out: str, config: dict, extension: Callable[[DataFrame | None], DataFrame] | None = None) -> Archive:
    """extension gives the typed rows of files, but for those it is told couldn't be read."""
    spark = encoded.sparkSession
    # Chunks are compressed once and written where they were read: no blob is shuffled or sorted.  The index is read back without them.
    # They are compressed already, so the file neither compresses them again nor looks for repeated values.
    encoded.write.mode("overwrite").option("compression", "uncompressed").option("parquet.enable.dictionary#blob", "false").parquet(f"{out}/blobs")
    bad = _readable(spark.read.schema(encoded.schema).parquet(f"{out}/blobs"), out) if "error" in encoded.columns else None
    written = spark.read.schema(encoded.schema).parquet(f"{out}/blobs").drop("blob", "error")
    _once(written)
    index = ingest.blob_layout(written)
    if extension is not None:
        index = ingest.attach(index, extension(bad).drop("pkg_type"))
    fields = [c for c in index.columns if c not in INDEX.names and c not in GROUP]
    index.select(*INDEX.names, *GROUP, *fields).repartitionByRange(*GROUP, "relative_path", "chunk_seq").sortWithinPartitions("relative_path", "chunk_seq").write.mode("overwrite").partitionBy(*GROUP).parquet(f"{out}/index")
    saved = config | {"schema": StructType([index.schema[n] for n in (*INDEX.names, *fields)]).jsonValue()}
    spark.createDataFrame([(json.dumps(saved),)], "config string").coalesce(1).write.mode("overwrite").json(f"{out}/config")
    archive = Archive(spark, out)
    ingest.manifest(archive.index()).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")
    return archive


def write(entries: DataFrame, out: str, no_skip: bool = False, plugins: tuple[Plugin, ...] = (), slice_size: int = ingest.SLICE, level: int = codec.LEVEL, algorithm: str = "sha256", on_duplicate: str = "reject", order: str = "entry_no") -> DataFrame:
    """Write entries as an archive and return its report, one row.

    Entries with one path are refused, or with on_duplicate='last' the one with the largest value in the column named by order is kept (it must not repeat).
    """
    if on_duplicate not in ("reject", "last"):
        raise ValueError(f"unknown on_duplicate {on_duplicate}")
    if on_duplicate == "last":
        entries = _last(entries, order)
    config = {"format_version": "3", "compression_level": level, "file_split_block_size": slice_size, "checksum": algorithm, "no_skip": no_skip}
    extension = (lambda _: Registry(list(plugins)).rows(entries)) if plugins else None
    archive = _put(encode(entries, no_skip, slice_size, level, algorithm), out, config, extension)
    return ingest.compression_report(archive.index())


def write_dir(spark: SparkSession, path: str, out: str, no_skip: bool = False, plugins: tuple[Plugin, ...] = (), repo: str = "", slice_size: int = ingest.SLICE, level: int = codec.LEVEL, mode: str = "strict") -> DataFrame:
    """Write a folder as an archive.  All files are read in ranges of slice_size, so none has to fit in a row; plugins see every file's path, or open it where they read bytes.

    A file that can't be read fails the job; with mode='permissive' it is left out, whole, and listed by Archive.errors.
    """
    ranges.register(spark)
    pkg_type = plugins[0].type_id if plugins else 0
    raw = spark.read.format("byte_ranges").option("rangeSize", slice_size).option("parallelism", spark.sparkContext.defaultParallelism).option("mode", mode).load(path)
    own = raw.withColumn("compressed", ~ingest.skip_flag(F.col("relative_path"), no_skip)).withColumn("pkg_type", F.lit(pkg_type).cast("tinyint")).withColumn("repo", F.lit(repo))
    more = ["error"] if mode == "permissive" else []
    encoded = codec.encode(own.select("relative_path", "chunk_seq", "fdata_offset", "compressed", "uncompressed_size", *GROUP, *more, "data"), level)

    def rows(bad: DataFrame | None) -> DataFrame:
        names = sources.names(spark, path)
        return Registry(list(plugins)).rows(names if bad is None else names.join(bad, "relative_path", "left_anti"))

    extension = rows if plugins else None
    config = {"format_version": "3", "compression_level": level, "file_split_block_size": slice_size, "checksum": "sha256", "no_skip": no_skip}
    return ingest.compression_report(_put(encoded, out, config, extension).index())


def safe_target(root: str, path: str) -> str:
    """Where a path of an archive is written; paths that lead out of root are refused."""
    if os.path.isabs(path) or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"unsafe path in archive: {path}")
    return os.path.join(root, path)


class Archive:
    """Views of a written archive; every one is a DataFrame that Spark plans and prunes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def config(self) -> dict:
        return json.loads(self.spark.read.schema("config string").json(f"{self.path}/config").first()[0])

    def config_rows(self) -> DataFrame:
        return self.spark.createDataFrame(sorted((k, str(v)) for k, v in self.config().items() if k != "schema"), "key string, value string")

    def index(self) -> DataFrame:
        schema = StructType.fromJson(self.config()["schema"]).add("pkg_type", "byte").add("repo", "string")
        return ingest.untyped(self.spark.read.schema(schema).parquet(f"{self.path}/index"))

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def blobs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blobs").drop("error")

    def errors(self) -> DataFrame:
        """(relative_path, error) of files that a permissive write left out."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/errors")
        none = not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.createDataFrame([], "relative_path string, error string") if none else self.spark.read.parquet(f"{self.path}/errors")

    def views(self, prefix: str = "archive") -> None:
        self.index().createOrReplaceTempView(f"{prefix}_index")
        self.manifest().createOrReplaceTempView(f"{prefix}_manifest")

    def listing(self) -> DataFrame:
        return reading.listing(self.index())

    def files(self) -> DataFrame:
        return reading.rollup(self.index())

    def file_count(self) -> int:
        return int(self.manifest().agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0])

    def contains(self, path: str) -> bool:
        return not self.index().where(F.col("relative_path") == path).limit(1).isEmpty()

    def file_size(self, path: str) -> int | None:
        return self.index().where(F.col("relative_path") == path).agg(F.sum("uncompressed_size")).first()[0]

    def decoded(self, rows: DataFrame | None = None) -> DataFrame:
        """Chunks with their bytes and status."""
        return codec.decode(self.blobs() if rows is None else rows, self.config()["checksum"])

    def extract_many(self, paths: DataFrame) -> DataFrame:
        """(relative_path, content, error) of each requested path; a missing one has an error and no content.

        Blobs of other paths are dropped before anything is decoded; up to MAX_LOOKUP paths are broadcast to the blobs.
        """
        wanted, rows = counted(paths.select("relative_path").distinct(), "wanted")
        found = reading.reassemble(self.decoded(self.blobs().join(F.broadcast(wanted) if rows <= MAX_LOOKUP else wanted, "relative_path", "left_semi")))
        return wanted.join(found, "relative_path", "left").withColumn("error", F.when(F.col("content").isNull(), F.lit("no such file")))

    def extract(self, path: str) -> bytes:
        own = reading.reassemble(self.decoded(self.blobs().where(F.col("relative_path") == path))).first()
        if own is None:
            raise KeyError(path)
        return bytes(own["content"])

    def status(self) -> DataFrame:
        return self.decoded().drop("data")

    def verify(self) -> DataFrame:
        return codec.verify_report(self.status())

    def extract_all(self, out_dir: str, repo: str | None = None, pkg_type: int | None = None, keep_corrupt: bool = False) -> DataFrame:
        """Write files, or those of one group, chunk by chunk at their offsets; returns the report of the chunks written.

        A corrupt chunk is left out unless asked for; out_dir must be a folder that all executors share.  Files are first made at their
        full size, from the sizes alone; then each chunk is decoded and written by the task that read it, so no bytes are shuffled.
        """
        rows = self.blobs()
        if repo is not None:
            rows = rows.where(F.col("repo") == repo)
        if pkg_type is not None:
            rows = rows.where(F.col("pkg_type") == pkg_type)
        root = local_path(out_dir)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    target = safe_target(root, path)
                    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
                    fd = os.open(target, os.O_CREAT | os.O_TRUNC | os.O_WRONLY, 0o644)
                    try:
                        os.ftruncate(fd, size)
                    finally:
                        os.close(fd)
                yield b.select([0])

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, at, status, data in zip(*(b.column(c).to_pylist() for c in ("relative_path", "fdata_offset", "status", "data"))):
                    if status == "ok" or (keep_corrupt and data is not None):
                        fd = os.open(safe_target(root, path), os.O_WRONLY)
                        try:
                            os.pwrite(fd, data, at)
                        finally:
                            os.close(fd)
                yield b.select(["relative_path", "status", "uncompressed_size"])

        sizes = rows.groupBy("relative_path").agg(F.sum("uncompressed_size").alias("file_size"))
        materialize(sizes.mapInArrow(make, "relative_path string"), "made")
        return codec.verify_report(materialize(self.decoded(rows).mapInArrow(put, "relative_path string, status string, uncompressed_size bigint"), "written"))


def open(spark: SparkSession, path: str) -> Archive:  # noqa: A001
    return Archive(spark, path)

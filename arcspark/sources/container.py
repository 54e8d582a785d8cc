"""Single-file archives: blobs, one Arrow stream for each group's index, a manifest stream and a footer.

The file ends with an 8-byte mark and the offset of the manifest; a file without the mark has one index, at the offset in its
last 8 bytes, and is read as one untyped group.  The mark of foreign archives is an option.  Compressed blobs of foreign codecs can't be decoded
here and raise; their manifest, index and stored blobs can be read.
"""

from __future__ import annotations

import io
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..schema import MANIFEST
from .ranges import local_path

MARK = b"ARCSMIDX"
ARROW_MANIFEST = pa.schema([pa.field(n, t, False) for n, t in (("pkg_type", pa.int8()), ("repo", pa.string()), ("module_name", pa.string()), ("index_offset", pa.uint64()), ("index_len", pa.uint64()), ("row_count", pa.uint64()))])
ARROW_INDEX = pa.schema(
    [
        pa.field(n, t, False)
        for n, t in (
            ("relative_path", pa.string()), ("chunk_seq", pa.uint32()), ("fdata_offset", pa.uint64()), ("compressed", pa.bool_()),
            ("uncompressed_size", pa.uint64()), ("blob_offset", pa.uint64()), ("blob_size", pa.uint64()), ("checksum", pa.binary(32)),
        )
    ]
)


def footer(tail: bytes, mark: bytes = MARK) -> tuple[str, int]:
    """('multi', offset of the manifest) or ('single', offset of the index), from a file's last 16 or 8 bytes."""
    if len(tail) < 8:
        raise ValueError("no archive: shorter than its footer")
    offset = int.from_bytes(tail[-8:], "little")
    return ("multi" if len(tail) >= 16 and tail[-16:-8] == mark else "single"), offset


def stream_bytes(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue()


def manifest_bytes(entries: list[dict]) -> bytes:
    return stream_bytes(pa.Table.from_pylist(entries, ARROW_MANIFEST))


def manifest_entries(data: bytes) -> list[dict]:
    table = pa.ipc.open_stream(data).read_all()
    for f in ARROW_MANIFEST:
        if table.schema.get_field_index(f.name) < 0 or table.schema.field(f.name).type != f.type:
            raise ValueError(f"manifest column {f.name} is missing or not {f.type}")
    return table.select(ARROW_MANIFEST.names).to_pylist()


def open_manifest(path: str, mark: bytes = MARK) -> list[dict]:
    with open(local_path(path), "rb") as f:
        size = f.seek(0, 2)
        f.seek(max(0, size - 16))
        kind, offset = footer(f.read(), mark)
        end = size - (16 if kind == "multi" else 8)
        if offset > end:
            raise ValueError("no archive: its footer points beyond its end")
        f.seek(offset)
        if kind == "multi":
            return manifest_entries(f.read(end - offset))
        with pa.ipc.open_stream(f.read(end - offset)) as own:
            rows = sum(b.num_rows for b in own)
        return [{"pkg_type": 0, "repo": "", "module_name": "", "index_offset": offset, "index_len": end - offset, "row_count": rows}]


def _signed(table: pa.Table) -> pa.Table:
    """Arrow types that Spark has no place for: unsigned and fixed-size binary columns."""
    for i, f in enumerate(table.schema):
        kind = {pa.uint8(): pa.int32(), pa.uint16(): pa.int32(), pa.uint32(): pa.int32(), pa.uint64(): pa.int64()}.get(f.type, pa.binary() if pa.types.is_fixed_size_binary(f.type) else None)
        if kind:
            table = table.set_column(i, pa.field(f.name, kind), table.column(i).cast(kind))
    return table


class Group(InputPartition):
    def __init__(self, entry: dict):
        self.entry = entry


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str], types: pa.Schema):
        self.path, self.table, self.mark = options["path"], options.get("table", "index"), bytes.fromhex(options.get("mark", MARK.hex()))
        self.names, self.types, self.keep = names, types, {}

    def partitions(self) -> list[Group]:
        entries = open_manifest(self.path, self.mark)
        if self.table == "manifest":
            return [Group({"all": entries})]
        return [Group(e) for e in entries if all(e[k] == v for k, v in self.keep.items())]

    def read(self, part: Group) -> Iterator[pa.RecordBatch]:
        if self.table == "manifest":
            yield from _signed(pa.Table.from_pylist(part.entry["all"], ARROW_MANIFEST)).to_batches()
            return
        e = part.entry
        with open(local_path(self.path), "rb") as f:
            f.seek(e["index_offset"])
            table = _signed(pa.ipc.open_stream(f.read(e["index_len"])).read_all())
        n = table.num_rows
        have = {c: table.column(c) for c in table.column_names} | {"pkg_type": pa.array([e["pkg_type"]] * n, pa.int8()), "repo": pa.array([e["repo"]] * n, pa.string())}
        cols = [have[c].cast(t.type) if c in have else pa.nulls(n, t.type) for c, t in zip(self.names, self.types)]
        yield from pa.Table.from_arrays(cols, self.names).to_batches()


class PushdownReader(ContainerReader):
    """Spark refuses a reader that takes filters where its session doesn't push any, so only such sessions get this one."""

    def pushFilters(self, filters):  # noqa: N802
        """Equality on the group's columns selects sub-indexes before any is read."""
        for f in filters:
            if self.table == "index" and isinstance(f, EqualTo) and f.attribute[0] in ("pkg_type", "repo"):
                self.keep[f.attribute[0]] = f.value
            else:
                yield f


class Container(DataSource):
    """spark.read.format('archive_container').option('table', 'index' or 'manifest').load(path); groups with further columns take a schema.

    Option pushdown: 'true' in a session that pushes filters to Python sources (index() sees to it).
    """

    @classmethod
    def name(cls) -> str:
        return "archive_container"

    def schema(self):
        if self.options.get("table", "index") == "manifest":
            return MANIFEST
        return "relative_path string, chunk_seq int, fdata_offset bigint, compressed boolean, uncompressed_size bigint, blob_offset bigint, blob_size bigint, checksum binary, pkg_type tinyint, repo string"

    def reader(self, schema) -> ContainerReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = PushdownReader if self.options.get("pushdown") == "true" else ContainerReader
        return kind(self.options, schema.names, to_arrow_schema(schema))


def index(spark: SparkSession, path: str, mark: bytes = MARK) -> DataFrame:
    spark.dataSource.register(Container)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("archive_container").option("mark", mark.hex()).option("pushdown", pushes).load(path)


def manifest(spark: SparkSession, path: str, mark: bytes = MARK) -> DataFrame:
    spark.dataSource.register(Container)
    return spark.read.format("archive_container").option("table", "manifest").option("mark", mark.hex()).load(path)


def write(encoded: DataFrame, path: str, mark: bytes = MARK, module: str = "") -> int:
    """Encoded chunks (index columns, blob, pkg_type, repo) as one file; returns its length.

    A single file has a single writer: rows stream through it one at a time in order of group, path and chunk, so the driver
    holds one blob and the index of one group.  Tables are the form for archives that many writers fill.
    """
    names = [f.name for f in ARROW_INDEX]
    rows = encoded.orderBy("pkg_type", "repo", "relative_path", "chunk_seq").select(*(n for n in names if n != "blob_offset"), "pkg_type", "repo", "blob")
    groups: list[tuple[tuple, int, int, object]] = []
    with open(local_path(path), "wb") as f:
        now, spool, writer, count, at = None, None, None, 0, 0
        batch: list[dict] = []

        def flush(last: bool) -> None:
            nonlocal batch
            if writer is not None and batch:
                writer.write_table(pa.Table.from_pylist(batch, ARROW_INDEX))
            batch = []
            if last and writer is not None:
                writer.close()
                groups.append((now, count, spool.tell(), spool))

        for r in rows.toLocalIterator(prefetchPartitions=True):
            key = (r["pkg_type"], r["repo"])
            if key != now:
                flush(True)
                now, spool, count = key, tempfile.TemporaryFile(), 0
                writer = pa.ipc.new_stream(spool, ARROW_INDEX)
            f.write(r["blob"])
            batch.append({n: at if n == "blob_offset" else (bytes(r[n]) if n == "checksum" else r[n]) for n in names})
            at += len(r["blob"])
            count += 1
            if len(batch) >= 4096:
                flush(False)
        flush(True)
        entries = []
        for (kind, repo), n, size, part in groups:
            part.seek(0)
            entries.append({"pkg_type": kind, "repo": repo, "module_name": module, "index_offset": at, "index_len": size, "row_count": n})
            while piece := part.read(1 << 20):
                f.write(piece)
            part.close()
            at += size
        tail = manifest_bytes(entries)
        f.write(tail + mark + at.to_bytes(8, "little"))
        f.flush()
        return f.tell()


def stored_blobs(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows of the index with their blob, read by position; compressed is left to the caller's codec."""
    own = local_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(own, "rb") as f:
            for b in batches:
                blobs = []
                for at, n in zip(b.column("blob_offset").to_pylist(), b.column("blob_size").to_pylist()):
                    f.seek(at)
                    blobs.append(f.read(n))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blobs, pa.binary())], [*b.schema.names, "blob"])

    return rows.mapInArrow(run, rows.withColumn("blob", F.lit(b"")).schema)

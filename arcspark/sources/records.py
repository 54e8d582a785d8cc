"""Files of fixed-width records: a signed little-endian key first, the rest as payload or as places; flat files of elements and zone maps."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import files_below, local_path


#: The records of elements (40 bytes) and of zone maps (32 bytes), fields at their natural alignment.
ELEMENTS = np.dtype([("file_offset", "<u8"), ("file_length", "<u4"), ("kind", "u1"), ("id", "<i8"), ("lat_e7", "<i4"), ("lon_e7", "<i4"), ("tag_flags", "<u4")], align=True)
ZONES = np.dtype([("index_start", "<u4"), ("index_end", "<u4"), ("kind_mask", "u1"), ("tag_flags", "<u4"), ("lat_min", "<i4"), ("lat_max", "<i4"), ("lon_min", "<i4"), ("lon_max", "<i4")], align=True)
#: Bounds of a zone without nodes.
NO_NODES = {"lat_min": 2**31 - 1, "lat_max": -(2**31), "lon_min": 2**31 - 1, "lon_max": -(2**31)}


def write_flat(df: DataFrame, path: str, kind: np.dtype, pos: str, rows: int) -> int:
    """Rows as one flat file of records, each at its place (column pos, from 0); returns the file's length.

    The file is made at its full size, then every task writes its own rows, a run of neighbouring places at once, so df
    should be sorted by pos within its partitions.  Null bounds of zones are those of a zone without nodes.
    """
    path = local_path(path)
    with open(path, "wb") as f:
        f.truncate(rows * kind.itemsize)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fd = os.open(path, os.O_WRONLY)
        try:
            for b in batches:
                at = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                own = np.zeros(len(at), kind)
                for n in kind.names:
                    col = b.column(b.schema.get_field_index(n))
                    own[n] = (pc.fill_null(col, NO_NODES.get(n, 0)) if col.null_count else col).to_numpy(zero_copy_only=False).astype(kind[n])
                edges = np.flatnonzero(np.r_[True, np.diff(at) != 1, True]) if len(at) else []
                for lo, hi in zip(edges, edges[1:]):
                    os.pwrite(fd, own[lo:hi].tobytes(), int(at[lo]) * kind.itemsize)
                yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int64())], ["n"])
        finally:
            os.close(fd)

    done = df.select(F.col(pos).alias("__at"), *kind.names).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if done != rows:
        raise ValueError(f"{done} rows for a file of {rows}")
    return rows * kind.itemsize


def read_flat(spark: SparkSession, path: str, kind: np.dtype, per_task: int = 1 << 20) -> DataFrame:
    """(pos, fields...) of a flat file; its length must be a multiple of the record's."""
    path, size, width = local_path(path), os.path.getsize(local_path(path)), kind.itemsize
    if size % width:
        raise ValueError(f"the length of {path} is no multiple of {width}")
    signed = {n: pa.int64() if kind[n].itemsize >= 4 and kind[n].kind == "u" or kind[n].itemsize == 8 else pa.int32() for n in kind.names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in b.column(0).to_pylist():
                own = np.fromfile(path, kind, min(per_task, size // width - lo), offset=lo * width)
                cols = [pa.array(own[n].astype(signed[n].to_pandas_dtype())) for n in kind.names]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(own))), *cols], ["pos", *kind.names])

    schema = "pos bigint, " + ", ".join(f"{n} {'bigint' if t == pa.int64() else 'int'}" for n, t in signed.items())
    starts = spark.range(0, size // width, per_task, numPartitions=max(1, -(-(size // width) // per_task)))
    return starts.mapInArrow(run, schema)


class Part(InputPartition):
    def __init__(self, path: str, at: int, n: int):
        self.path, self.at, self.n = path, at, n


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.stride = options["path"], int(options.get("stride", 16))
        self.per_task = int(options.get("recordspertask", 1 << 22))
        if self.stride < 8:
            raise ValueError("a record has at least 8 bytes")

    def partitions(self) -> list[Part]:
        out = []
        for path, size in files_below(self.root):
            if size % self.stride:
                raise ValueError(f"the length of {path} is no multiple of {self.stride}")
            n = size // self.stride
            out += [Part(path, at, min(self.per_task, n - at)) for at in range(0, n, self.per_task)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        step = 1 << 16
        with open(part.path, "rb") as f:
            f.seek(part.at * self.stride)
            for lo in range(0, part.n, step):
                n = min(step, part.n - lo)
                raw = np.frombuffer(f.read(n * self.stride), np.uint8).reshape(n, self.stride)
                ids = raw[:, :8].copy().view("<i8").ravel()
                rest = [r.tobytes() for r in raw[:, 8:]]
                pos = np.arange(part.at + lo, part.at + lo + n)
                cols = [pa.array([os.path.basename(part.path)] * n), pa.array(pos), pa.array(ids), pa.array(rest, pa.binary())]
                if self.stride == 16:
                    places = raw[:, 8:].copy().view("<f4")
                    cols += [pa.array(places[:, 0]), pa.array(places[:, 1])]
                else:
                    cols += [pa.nulls(n, pa.float32())] * 2
                yield pa.RecordBatch.from_arrays(cols, ["file", "pos", "id", "payload", "lat", "lon"])


class Records(DataSource):
    """spark.read.format('fixed_records').option('stride', n).load(path); records of 16 bytes also as (id, lat, lon)."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return "file string, pos bigint, id bigint, payload binary, lat float, lon float"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def records(spark: SparkSession, path: str, stride: int = 16) -> DataFrame:
    spark.dataSource.register(Records)
    return spark.read.format("fixed_records").option("stride", stride).load(path)

"""Ordered split-and-transform over bytes: records are cut at boundaries and carried across reads.

A splitter takes bytes and returns (segments, consumed); what it doesn't consume is carried into the next read.  Each range of a
file is one task: it begins after the first boundary at or after its start and finishes the record that crosses its
end, so every record belongs to one task and (path, at) is the order of the stream.

A user's own splitter works on ranges alike where a function finds the next start of a segment from any place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..sources.ranges import files_below

Splitter = Callable[[bytes], tuple[list[bytes], int]]
Transform = Callable[[bytes], list[tuple]]
#: Offset of the first start of a segment in data at or after a place, or -1 if there is none.
FindStart = Callable[[bytes, int], int]
RECORD_LIMIT = 64 << 20


def by_delimiter(delimiter: bytes = b"\n") -> Splitter:
    """Segments that end with the delimiter."""

    def split(data: bytes) -> tuple[list[bytes], int]:
        parts = data.split(delimiter)
        return [p + delimiter for p in parts[:-1]], len(data) - len(parts[-1])

    return split


def segments_of(read: Callable[[int], bytes], split: Splitter, chunk: int, limit: int = RECORD_LIMIT) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, segment, whether it is the last) of a byte stream; what no boundary ends is the last segment.

    A record that grows beyond limit without a boundary raises.
    """
    carry, at, held = b"", 0, None
    while data := read(chunk):
        carry += data
        found, used = split(carry)
        for s in found:
            if held:
                yield *held, False
            held = (at, s)
            at += len(s)
        carry = carry[used:]
        if len(carry) > limit:
            raise ValueError(f"no boundary within {limit} bytes at {at}")
    if carry:
        if held:
            yield *held, False
        held = (at, carry)
    if held:
        yield *held, True


def transform(spark: SparkSession, path: str, fn: Transform, schema: StructType, delimiter: bytes = b"\n", range_size: int = 64 << 20, finish: Callable[[], list[tuple]] | None = None, split: Splitter | None = None, find_start: FindStart | None = None, chunk: int = 1 << 20, with_last: bool = False) -> DataFrame:
    """(path, at, n, fields...): rows fn gives for each record, n numbering those of one record.

    finish gives rows after the last record of a range (a worker's tail); they carry the range's end as at.
    split and find_start together replace the delimiter: segments are then what split gives, with their delimiters.
    with_last: fn also takes whether the segment is the last of its file.
    """
    if (split is None) != (find_start is None):
        raise ValueError("split and find_start go together")
    if with_last and split is None:
        split, find_start = by_delimiter(delimiter), after_delimiter(delimiter)
    out = StructType([StructField("path", StringType()), StructField("at", LongType()), StructField("n", LongType()), *schema.fields])
    arrow = to_arrow_schema(out)
    spans = [(p, a, min(a + range_size, size), size) for p, size in files_below(path) for a in range(0, size, range_size)]
    plan = spark.createDataFrame(spans, "path string, begin bigint, end bigint, size bigint").repartition(max(1, len(spans)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, begin, end, _ in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows = []
                found = ((at, (x, last) if with_last else (x,)) for at, x, last in segments_in(p, begin, end, split, find_start, chunk)) if split else ((at, (x,)) for at, x in records(p, begin, end, delimiter, chunk))
                for at, record in found:
                    rows += [(p, at, n, *r) for n, r in enumerate(fn(*record))]
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(out.names, r)) for r in rows], arrow)
                        rows = []
                if finish:
                    rows += [(p, end, n, *r) for n, r in enumerate(finish())]
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, r)) for r in rows], arrow)

    return plan.mapInArrow(run, out)


def after_delimiter(delimiter: bytes = b"\n") -> FindStart:
    """Starts right behind a delimiter."""

    def find(data: bytes, at: int) -> int:
        cut = data.find(delimiter, max(0, at - len(delimiter)))
        return -1 if cut < 0 else cut + len(delimiter)

    return find


def segments_in(path: str, begin: int, end: int, split: Splitter, find_start: FindStart, chunk: int = 1 << 20, limit: int = RECORD_LIMIT) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, segment, whether it is the file's last) of the segments that begin in [begin, end) of a file; find_start sees up to 64 bytes before begin."""
    with open(path, "rb") as f:
        back = min(begin, 64)
        f.seek(begin - back)
        data, at = b"", begin - back
        if begin:
            while (start := find_start(data, back)) < 0:
                more = f.read(chunk)
                if not more:
                    return
                data += more
                if len(data) > limit:
                    raise ValueError(f"no boundary within {limit} bytes at {at}")
            at, data = at + start, data[start:]
            if at >= end:
                return
        first = [data] if data else []
        for offset, segment, last in segments_of(lambda n: first.pop() if first else f.read(n), split, chunk, limit):
            if at + offset >= end:
                return
            yield at + offset, segment, last


def records(path: str, begin: int, end: int, delimiter: bytes = b"\n", chunk: int = 1 << 20, limit: int = RECORD_LIMIT) -> Iterator[tuple[int, bytes]]:
    """(offset, record without delimiter) of records that begin in [begin, end) of a file."""
    with open(path, "rb") as f:
        # A record begins at 0 or right after a delimiter; looking from before begin finds one that ends there.
        back = len(delimiter) if begin else 0
        f.seek(begin - back)
        data, at = f.read(chunk), begin - back
        if begin:
            while (cut := data.find(delimiter)) < 0:
                more = f.read(chunk)
                if not more:
                    return
                data += more
                if len(data) > limit:
                    raise ValueError(f"no boundary within {limit} bytes at {at}")
            data, at = data[cut + len(delimiter) :], at + cut + len(delimiter)
        while at < end:
            while (cut := data.find(delimiter)) < 0:
                more = f.read(chunk)
                if not more:
                    if data:
                        yield at, data
                    return
                data += more
                if len(data) > limit:
                    raise ValueError(f"no boundary within {limit} bytes at {at}")
            yield at, data[:cut]
            data, at = data[cut + len(delimiter) :], at + cut + len(delimiter)


def bytes_of(df: DataFrame) -> DataFrame:
    """Segments of one path joined again in order, for sinks that take bytes."""
    return df.groupBy("path").agg(F.expr("listagg(data) within group (order by at, n)").alias("content"))


SEGMENT = StructType([StructField("data", BinaryType())])



"""Elements of map XML with their byte offsets, scanned by ranges.

A range owns the elements whose '<' lies in it and reads past its end to finish the last one, so ranges need neither
overlap nor merging: the union of their rows is the scan of the whole file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ELEMENT
from .ranges import files_below

#: Element kinds, and the tag keys in order of their bits.
KINDS = {b"node": 0, b"way": 1, b"relation": 2}
TAG_KEYS = (b"highway", b"building", b"natural", b"landuse", b"waterway", b"railway", b"amenity", b"boundary")
#: An element longer than this can't be finished across the end of a range.
MARGIN = 512 << 10
TAG = re.compile(rb"<([^>]*)>")
ATTRIBUTE = re.compile(rb'([^ \n=]*)=[^"]*"([^"]*)"')
TOP = re.compile(rb"<(?:node|way|relation)[ \t]")
TOP_STRICT = re.compile(rb"<(?:node|way|relation) ")


def whole(text: bytes | None) -> int:
    """A leading '-' and the digits of text; missing text is 0."""
    if not text:
        return 0
    digits = bytes(c for c in text if 48 <= c <= 57)
    return (-1 if text[:1] == b"-" else 1) * int(digits or b"0")


def degrees(text: bytes | None) -> int:
    """Decimal degrees x 10**7, cut after the seventh decimal."""
    if not text:
        return 0
    head, _, tail = text.lstrip(b"-").partition(b".")
    only = lambda b: bytes(c for c in b if 48 <= c <= 57)
    value = int((only(head) + only(tail)[:7].ljust(7, b"0")) or b"0")
    value = (value + (1 << 31)) % (1 << 32) - (1 << 31)
    return -value if text[:1] == b"-" else value


def attributes(tag: bytes) -> dict[bytes, bytes]:
    out: dict[bytes, bytes] = {}
    for name, value in ATTRIBUTE.findall(tag):
        out.setdefault(name, value)
    return out


def next_start(data: bytes, at: int, strict: bool = False) -> int:
    """Offset of the next top-level element at or after at, or the length of data."""
    found = (TOP_STRICT if strict else TOP).search(data, at)
    return found.start() if found else len(data)


def safe_end(data: bytes, margin: int = MARGIN) -> int:
    """End of the last element that is complete within data, looked for in its last bytes; 0 if there is none."""
    low = max(0, len(data) - margin)
    ends = [m.end() for m in re.finditer(rb"</(?:node|way|relation)>|<(?:node|way|relation)\s[^>]*/>", data[low:])]
    return low + ends[-1] if ends else 0


def count(data: bytes) -> int:
    """Top-level elements without parsing them."""
    return len(TOP.findall(data))


def scan(data: bytes, begin: int = 0, end: int | None = None, base: int = 0, strict: bool = False) -> Iterator[tuple]:
    """Elements whose '<' lies in data[begin:end].

    Comments and end tags are passed over to their next '>'.  Flags come from the tag children before the first end tag.
    An element without its end reaches to the end of data.  strict: a name ends at a space only, not at a tab.
    """
    end = len(data) if end is None else end
    at = begin
    while m := TAG.search(data, at):
        if m.start() >= end:
            return
        body = m[1]
        name = body.split(b" ", 1)[0] if strict else re.split(rb"[ \t]", body, maxsplit=1)[0]
        kind = KINDS.get(name.removesuffix(b"/"))
        if kind is None or (strict and kind is not None and name not in KINDS):
            at = m.end()
            continue
        closed = body.endswith(b"/")
        attrs = attributes(body.rstrip(b"/") if closed else body)
        flags, stop = 0, m.end()
        if not closed:
            key = b"</" + name + b">"
            found = data.find(key, m.end())
            stop = found + len(key) if found >= 0 else len(data)
            for child in TAG.finditer(data, m.end()):
                inner = child[1]
                if inner.startswith(b"/"):
                    break
                if inner.split(b" ", 1)[0] == b"tag":
                    k = attributes(inner).get(b"k")
                    if k in TAG_KEYS:
                        flags |= 1 << TAG_KEYS.index(k)
        yield base + m.start(), stop - m.start(), kind, whole(attrs.get(b"id")), degrees(attrs.get(b"lat")), degrees(attrs.get(b"lon")), flags
        at = stop


class Span(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class ElementReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.size = int(options.get("rangesize", 64 << 20))
        self.margin = int(options.get("margin", MARGIN))
        self.strict = options.get("strict", "false") == "true"

    def partitions(self) -> list[Span]:
        return [Span(p, at, min(at + self.size, n)) for p, n in files_below(self.root) for at in range(0, n, self.size)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        with open(span.path, "rb") as f:
            f.seek(span.begin)
            data = f.read(span.end - span.begin + self.margin)
            whole_file = not f.read(1)
        own = span.end - span.begin
        # A range that begins inside an element starts at the next one; the one before it is finished by its own range.
        begin = next_start(data, 0, self.strict) if span.begin else 0
        names = [x.split()[0] for x in ELEMENT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        found = scan(data, begin, own, span.begin, self.strict)
        # Rows leave in batches, so a task holds the bytes of its range and the rows of one batch.
        while rows := list(islice(found, 10_000)):
            for row in rows:
                if not whole_file and row[0] - span.begin + row[1] >= len(data):
                    raise ValueError(f"element at {row[0]} of {span.path} is longer than the margin of {self.margin} bytes")
            yield pa.RecordBatch.from_arrays([pa.array([span.path] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["path", *names])


class Elements(DataSource):
    """spark.read.format('map_elements').option('rangeSize', n).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "map_elements"

    def schema(self) -> str:
        return f"path string, {ELEMENT}"

    def reader(self, schema) -> ElementReader:
        return ElementReader(self.options)


def sliced(elements: DataFrame) -> DataFrame:
    """Elements (path, file_offset, file_length, ...) with column xml, their bytes; one whose slice leaves its file is dropped.

    Files are read by position on the executors, a batch's in order of path and offset.
    """
    schema = elements.withColumn("xml", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, at, n = (b.column(c).to_pylist() for c in ("path", "file_offset", "file_length"))
            out: list[bytes | None] = [None] * b.num_rows
            now, f = None, None
            for i in sorted(range(b.num_rows), key=lambda i: (path[i] or "", at[i] or 0)):
                if path[i] is None or at[i] is None or n[i] is None or at[i] < 0 or n[i] < 0:
                    continue
                if path[i] != now:
                    if f:
                        f.close()
                    now, f = path[i], open(path[i], "rb")
                f.seek(at[i])
                data = f.read(n[i])
                out[i] = data if len(data) == n[i] else None
            if f:
                f.close()
            xml = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, xml], [*b.schema.names, "xml"]).filter(xml.is_valid())

    return elements.mapInArrow(run, schema)


def elements(spark: SparkSession, path: str, range_size: int = 64 << 20, strict: bool = False) -> DataFrame:
    spark.dataSource.register(Elements)
    return spark.read.format("map_elements").option("rangeSize", range_size).option("strict", str(strict).lower()).load(path)

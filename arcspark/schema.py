"""Schemas of the index, the manifest, elements and zone maps, and how foreign types widen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, IntegerType, LongType, StringType, StructField, StructType

INDEX = StructType(
    [
        StructField("relative_path", StringType(), False),
        StructField("chunk_seq", IntegerType(), False),
        StructField("fdata_offset", LongType(), False),
        StructField("compressed", BooleanType(), False),
        StructField("uncompressed_size", LongType(), False),
        StructField("blob_offset", LongType(), False),
        StructField("blob_size", LongType(), False),
        StructField("checksum", BinaryType(), False),
    ]
)
MANIFEST = StructType(
    [
        StructField("pkg_type", ByteType(), False),
        StructField("repo", StringType(), False),
        StructField("module_name", StringType(), False),
        StructField("index_offset", LongType(), False),
        StructField("index_len", LongType(), False),
        StructField("row_count", LongType(), False),
    ]
)
ELEMENT = "file_offset bigint, file_length bigint, kind tinyint, id bigint, lat_e7 int, lon_e7 int, tag_flags int"
#: Tags of a declared column; an unknown tag is text.
DECLARED = {"utf8": StringType(), "u32": IntegerType(), "i8": ByteType(), "list": ArrayType(StringType()), "bytes": BinaryType()}


def declared(text: str) -> StructType:
    """'name:type,...' as nullable columns."""
    pairs = (p.strip().partition(":") for p in text.split(",") if p.strip())
    return StructType([StructField(n.strip(), DECLARED.get(t.strip(), StringType()), True) for n, _, t in pairs])


def compose(extension: StructType | None = None) -> StructType:
    """The index schema, with pkg_type and the extension's columns if there are any."""
    if extension is None or not extension.fields:
        return INDEX
    return StructType([*INDEX.fields, StructField("pkg_type", ByteType(), True), *extension.fields])


def widen(df: DataFrame) -> DataFrame:
    """Index columns as a table stores them: small integers become int."""
    return df.select(*(F.col(f.name).cast("int").alias(f.name) if f.dataType.typeName() in ("byte", "short") else F.col(f.name) for f in df.schema))

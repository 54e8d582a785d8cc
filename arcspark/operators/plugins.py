"""Plugins: typed columns from a file's path and bytes, several at once, in Arrow batches."""

from __future__ import annotations

import tarfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, ByteType, StringType, StructField, StructType

from ..functions import maven as M
from ..functions import packages as P
from ..functions.archives import opened, unreadable, zip_find
from ..schema import declared as declared_schema

Extract = Callable[[str, bytes], dict | None]
#: Package types by number.
TYPE_IDS = {"raw": 0, "maven": 1, "cargo": 2, "npm": 3, "pypi": 4, "docker": 5, "helm": 6, "named": 7}


@dataclass(frozen=True)
class Plugin:
    """suffixes select files; columns (expressions of the path) or extract (path, bytes) give their typed row.

    needs_data: whether extract looks at the bytes; otherwise they aren't sent to Python.
    opens: whether extract also takes an open file in place of the bytes, so that no file has to fit in memory.
    """

    name: str
    type_id: int
    suffixes: tuple[str, ...]
    schema: StructType
    extract: Extract | None = None
    columns: Callable[[Column], Column] | None = None
    needs_data: bool = True
    opens: bool = False

    def matches(self, path: Column) -> Column:
        return P.matches(path, *self.suffixes)

    def rows(self, entries: DataFrame) -> DataFrame:
        """(relative_path, pkg_type, fields...): a row for each matching file that has metadata.

        Entries have their content, or the file to open for it; a file that can't be read raises.
        """
        own = entries.where(self.matches(F.col("relative_path")))
        head = StructType([StructField("relative_path", StringType()), StructField("pkg_type", ByteType())])
        if self.columns:
            found = own.select("relative_path", F.lit(self.type_id).cast("tinyint").alias("pkg_type"), self.columns(F.col("relative_path")).alias("x")).where("x is not null")
            return found.select("relative_path", "pkg_type", *(F.col(f"x.{f.name}").alias(f.name) for f in self.schema))
        out = StructType([*head.fields, *self.schema.fields])
        arrow, extract, type_id, names = to_arrow_schema(out), self.extract, self.type_id, self.schema.names
        opens, from_file = self.opens, self.needs_data and "content" not in entries.columns

        def one(path: str, data: pa.Scalar) -> dict | None:
            if not from_file:
                return extract(path, data.as_py() or b"")
            with open(data.as_py(), "rb") as f:
                return extract(path, f if opens else f.read())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                    x = one(path, data)
                    if x is not None:
                        rows.append({"relative_path": path, "pkg_type": type_id} | {n: x.get(n) for n in names})
                yield pa.RecordBatch.from_pylist(rows, arrow)

        data = F.col("file") if from_file else F.col("content").cast("binary") if self.needs_data else F.lit(None).cast("binary")
        return own.select("relative_path", data.alias("content")).mapInArrow(run, out)


@dataclass
class Staged:
    """Files put together in memory before they become entries: push, extract metadata, drain."""

    files: list[tuple[str, bytes]] = field(default_factory=list)

    def push(self, path: str, data: bytes) -> Staged:
        self.files.append((path, bytes(data)))
        return self

    def __len__(self) -> int:
        return len(self.files)

    def total_bytes(self) -> int:
        return sum(len(d) for _, d in self.files)

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, bytearray(d), None, None) for p, d in self.files], "relative_path string, content binary, pkg_type tinyint, repo string")

    def extract(self, spark: SparkSession, plugin: Plugin) -> DataFrame:
        """Typed rows of the staged files, which stay."""
        return plugin.rows(self.entries(spark))

    def drain(self, spark: SparkSession) -> DataFrame:
        """The staged files as entries; nothing is staged afterwards."""
        out = self.entries(spark)
        self.files = []
        return out


@dataclass
class Registry:
    """Active plugins; a file belongs to the first one that matches its path."""

    plugins: list[Plugin] = field(default_factory=list)

    def register(self, plugin: Plugin) -> Registry:
        self.plugins.append(plugin)
        return self

    def schema(self) -> StructType:
        fields: dict[str, StructField] = {}
        for p in self.plugins:
            for f in p.schema:
                if fields.setdefault(f.name, f).dataType != f.dataType:
                    raise ValueError(f"plugins disagree on the type of {f.name}")
        return StructType(list(fields.values()))

    def rows(self, entries: DataFrame) -> DataFrame | None:
        """Typed rows of all plugins as one table, null where a plugin lacks a column."""
        out, before = None, F.lit(False)
        for p in self.plugins:
            part = p.rows(entries.where(~before))
            before = before | p.matches(F.col("relative_path"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out


def crate_dependencies(data: bytes | BinaryIO) -> list[str]:
    """Names in the [dependencies] section of the first Cargo.toml of a crate."""
    try:
        with tarfile.open(fileobj=opened(data), mode="r:gz") as t:
            member = next((m for m in t if m.name == "Cargo.toml" or m.name.endswith("/Cargo.toml")), None)
            text = t.extractfile(member).read().decode() if member else ""
    except (tarfile.TarError, EOFError, OSError, zlib.error, UnicodeDecodeError, AttributeError) as e:
        if unreadable(e):
            raise
        return []
    names, section = [], ""
    for line in map(str.strip, text.splitlines()):
        if line.startswith("["):
            section = line
        elif section == "[dependencies]" and (name := line.split("=")[0].strip()) and not name.startswith("#"):
            names.append(name)
    return names


CRATE = StructType([StructField("name", StringType()), StructField("version", StringType())])
WHEEL = StructType([StructField(n, StringType()) for n in ("name", "version", "build_tag", "python_tag", "abi_tag", "platform_tag")])
WHEEL_FULL = StructType([*WHEEL.fields, StructField("requires_dist", ArrayType(StringType()))])


def _crate(path: str, data: bytes) -> dict | None:
    base = path.rsplit("/", 1)[-1].removesuffix(".crate")
    at = max((i for i in range(len(base) - 1) if base[i] == "-" and base[i + 1] in "0123456789"), default=None)
    return None if at is None else {"name": base[:at], "version": base[at + 1 :], "dependencies": crate_dependencies(data)}


def cargo(deps: bool = False) -> Plugin:
    if not deps:
        return Plugin("cargo", TYPE_IDS["cargo"], P.CARGO, CRATE, columns=P.crate)
    return Plugin("cargo", TYPE_IDS["cargo"], P.CARGO, StructType([*CRATE.fields, StructField("dependencies", ArrayType(StringType()))]), extract=_crate, opens=True)


def maven() -> Plugin:
    return Plugin("maven", TYPE_IDS["maven"], P.MAVEN, M.PROJECT, extract=M.extract, opens=True)


def wheel_files(data: bytes | BinaryIO) -> dict[str, str]:
    """METADATA and RECORD of a wheel, the first of each under a .dist-info folder."""
    out: dict[str, str] = {}
    for name, body in zip_find(data, ".dist-info/"):
        kind = name.rsplit("/", 1)[-1]
        if kind in ("METADATA", "RECORD"):
            out.setdefault(kind, body.decode("utf-8", "replace"))
    return out


def requirements(metadata: str) -> list[str]:
    key = "Requires-Dist:"
    return [x.removeprefix(key).strip() for x in metadata.splitlines() if x.startswith(key)]


def _pypi_data(path: str, data: bytes) -> dict | None:
    found = requirements(wheel_files(data).get("METADATA", "")) if path.endswith(".whl") else []
    return {"requires_dist": found} if found else None


def pypi(deps: bool = False) -> Plugin:
    """Fields of wheel and source archive names; with deps also the requirements a wheel carries."""
    if not deps:
        return Plugin("pypi", TYPE_IDS["pypi"], P.PYPI, WHEEL, columns=P.pypi)
    return _PypiWithDeps("pypi", TYPE_IDS["pypi"], P.PYPI, WHEEL_FULL)


class _PypiWithDeps(Plugin):
    def rows(self, entries: DataFrame) -> DataFrame:
        names = pypi().rows(entries)
        needs = Plugin("requires", self.type_id, (".whl",), StructType([StructField("requires_dist", ArrayType(StringType()))]), extract=_pypi_data, opens=True).rows(entries)
        return names.join(needs.drop("pkg_type"), "relative_path", "left")


def declared(name: str, type_id: int, suffixes: tuple[str, ...], schema: str, extract: Extract) -> Plugin:
    """A plugin whose columns are declared as 'name:type,...'."""
    return Plugin(name, type_id, suffixes, declared_schema(schema), extract=extract)


def json_rows(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A plugin's JSON answers as typed columns; 'null' and broken answers give null."""
    return rows.withColumn("x", F.from_json(column, declared_schema(schema))).select(*(c for c in rows.columns), "x.*")

"""Project coordinates and dependencies of Maven POMs, read leniently: what precedes an XML error counts."""

from __future__ import annotations

from collections.abc import Callable
from typing import BinaryIO
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .archives import zip_find

PROJECT = StructType([StructField(n, StringType()) for n in ("group_id", "artifact_id", "version", "packaging")])
DEPENDENCY = StructType([*PROJECT.fields, StructField("classifier", StringType()), StructField("scope", StringType())])
#: The elements read, and the scopes left out.
FIELDS = {"groupId": "group_id", "artifactId": "artifact_id", "version": "version", "type": "packaging", "packaging": "packaging", "classifier": "classifier", "scope": "scope"}
LEFT_OUT = ("test", "provided", "system")


def _read(xml: bytes, on_text: Callable[[list[str], str], None], on_end: Callable[[list[str]], None]) -> None:
    """Calls on_text(path, text) for each run of text that isn't blank and on_end(path) before each end tag, up to the first error."""
    path: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = "".join(run).strip()
        run.clear()
        if text and path:
            on_text(path, text)

    def start(name: str, _: dict) -> None:
        flush()
        path.append(name)

    def end(_: str) -> None:
        flush()
        on_end(path)
        path.pop()

    p = expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, run.append
    p.CommentHandler = p.ProcessingInstructionHandler = lambda *_: flush()
    try:
        p.Parse(xml, True)
    except (expat.ExpatError, ValueError):
        return


def project(xml: bytes) -> dict | None:
    """The POM's own coordinate from the direct children of its root; packaging is jar unless given."""
    own = {"group_id": "", "artifact_id": "", "version": "", "packaging": "jar"}

    def text(path: list[str], value: str) -> None:
        if len(path) == 2 and path[1] in ("groupId", "artifactId", "version", "packaging"):
            own[FIELDS[path[1]]] = value

    _read(xml, text, lambda _: None)
    return own if own["group_id"] and own["artifact_id"] and own["version"] else None


def dependencies(xml: bytes, exclusions_overwrite: bool = True) -> list[dict]:
    """Dependencies directly under the root that have a full coordinate and a scope that is kept.

    With exclusions_overwrite an exclusion's ids replace those of its dependency, as the format's own reader has it.
    """
    out: list[dict] = []
    now: dict = {}

    def inside(path: list[str]) -> bool:
        return len(path) >= 3 and path[1] == "dependencies" and "dependency" in path[2:]

    def text(path: list[str], value: str) -> None:
        if inside(path) and path[-1] in FIELDS and (exclusions_overwrite or len(path) == 4):
            now[FIELDS[path[-1]]] = value

    def end(path: list[str]) -> None:
        if path[-1] == "dependency" and len(path) >= 3 and path[1] == "dependencies":
            if all(now.get(k) for k in ("group_id", "artifact_id", "version")) and now.get("scope") not in LEFT_OUT:
                out.append({f.name: now.get(f.name) for f in DEPENDENCY} | {"packaging": now.get("packaging") or "jar"})
            now.clear()

    _read(xml, text, end)
    return out


def pom_of(path: str, data: bytes | BinaryIO) -> bytes | None:
    """The POM itself, or the one that a JAR carries under META-INF/maven."""
    if path.endswith(".pom"):
        return data.read() if hasattr(data, "read") else data
    return next((d for n, d in zip_find(data, "pom.xml") if n.startswith("META-INF/maven/") and n.endswith("/pom.xml")), None)


def extract(path: str, data: bytes | BinaryIO | None) -> dict | None:
    pom = pom_of(path, data or b"")
    return project(pom) if pom is not None else None


def project_of(xml: Column) -> Column:
    @F.pandas_udf(PROJECT)
    def run(x: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(PROJECT.names)
        return pd.DataFrame([(project(bytes(v)) if v is not None else None) or none for v in x], columns=PROJECT.names)

    return run(xml.cast("binary"))


def dependencies_of(xml: Column, exclusions_overwrite: bool = True) -> Column:
    @F.pandas_udf(ArrayType(DEPENDENCY))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: dependencies(bytes(v), exclusions_overwrite) if v is not None else [])

    return run(xml.cast("binary"))

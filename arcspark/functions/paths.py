"""Paths as places: one spelling for all paths that lead to the same file."""

from __future__ import annotations

import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def resolve(path: str | None) -> str | None:
    """The place a path leads to, read from one root.

    Percent codes are decoded once (bytes that aren't UTF-8 become U+FFFD), composed and decomposed characters,
    letter case and the kind and number of separators are levelled, '.' and '..' are followed; '..' at
    the root stays there.
    """
    if path is None:
        return None
    if "%" in path:
        path = unquote(path, errors="replace")
    if not path.isascii():
        path = unicodedata.normalize("NFC", unicodedata.normalize("NFC", path).casefold())
    else:
        path = path.lower()
    parts: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            if parts:
                parts.pop()
        elif part and part != ".":
            parts.append(part)
    return "/".join(parts)


@F.pandas_udf(StringType())
def place(path: pd.Series) -> pd.Series:
    return path.map(resolve, na_action="ignore")

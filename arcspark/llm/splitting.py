"""Cutting oversized documents at natural boundaries, with overlap (problem 7).

Pointer doubling.  Every token boundary of a text is joined to its farthest legal successor: the end of the longest
piece that may follow a cut there, which begins overlap tokens before the cut.  That table is squared again and
again (a successor's successor, its successor's, ...), and the set of cuts reached from the start of the
text doubles with each squaring, so all greedy cuts are known after log2(pieces) steps, for all documents
of a batch at once, in array operations and without a loop over pieces.

A successor is, of those within reach, the last end of a paragraph in the further half of the reach; else the last end of a
sentence there; else the last weaker boundary there (line, clause, white space); else the same in this order
within the nearer half; else the last token boundary.

Defined results: pieces cover the text without a gap and, but for the overlap, once; none has more
than limit tokens (but a single character that has more); consecutive pieces share exactly overlap tokens, or up to 3 more where a piece would begin
inside a character; a text of up to limit tokens, white space only included, is one piece; null and empty texts give none; rows with equal or null doc_id are cut each on its own.
Tokens are those of the word rule ('words') or of a public tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T

LIMIT = 2048
OVERLAP = 128
#: Ends of paragraphs, of sentences and of lines or clauses; matched at the white space that follows.
PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'»“”’)\]]*\s+|[。！？]")
WEAKER = re.compile(r"\s*[\r\n]\s*|(?<=[,;:])\s+")
SPACE = re.compile(r"\s+")
SCHEMA = "doc_id bigint, piece int, start_char bigint, end_char bigint, tokens int, text string"


def boundaries(text: str, starts: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Level of the boundary before each token (and at the end): 1 paragraph, 2 sentence, 3 line or clause, 4 white space, 5 other.

    A token may begin with the white space before a word, so a boundary is the last token that begins in its white space or after it.
    """
    level = np.full(len(starts) + 1, 5, np.int8)
    index = np.arange(len(starts)) if whole is None else np.flatnonzero(whole)
    own = starts[index]
    for value, rule in ((4, SPACE), (3, WEAKER), (2, SENTENCE), (1, PARAGRAPH)):
        spans = np.array([(m.start() + len(m[0].rstrip()), m.end()) for m in rule.finditer(text)], np.int64).reshape(-1, 2)
        if len(spans) and len(own):
            at = np.searchsorted(own, spans[:, 1], side="right") - 1
            level[index[at[(at >= 0) & (own[at] >= spans[:, 0])]]] = value
    level[0] = level[-1] = 1
    return level


def begins(n: int, overlap: int, whole: np.ndarray | None = None) -> np.ndarray:
    """For a cut at each boundary the token its next piece begins with: overlap tokens before, or up to 3 more not to begin inside a character."""
    at = np.maximum(np.arange(n + 1) - overlap, 0)
    return at if whole is None else np.maximum.accumulate(np.where(np.append(whole, True), np.arange(n + 1), 0))[at]


def successors(level: np.ndarray, limit: int, overlap: int, whole: np.ndarray | None = None) -> np.ndarray:
    """For each boundary the farthest legal one after it; the last boundary leads to itself.  whole: tokens that don't begin inside a character."""
    n = len(level) - 1
    at = np.arange(n + 1)
    ok = np.ones(n + 1, bool) if whole is None else np.append(whole, True)
    # A piece after a cut at c begins at c - overlap; one after the start begins at 0.
    begin = begins(n, overlap, whole)
    reach = np.maximum.accumulate(np.where(ok, at, 0))[np.minimum(begin + limit, n)]
    # Where the limit leaves no room for one more character, that one is taken.
    after = np.minimum.accumulate(np.where(ok, at, n)[::-1])[::-1]
    reach = np.where(reach > at, reach, after[np.minimum(at + 1, n)])
    half = at + (reach - at + 1) // 2
    out = np.full(n + 1, -1)
    last = [np.maximum.accumulate(np.where(ok & (level <= v), at, -1))[reach] for v in (1, 2, 3, 4)]
    # A piece must reach so far that the next doesn't begin where it began; the first past the overlap.
    least = np.minimum(np.searchsorted(begin, begin, side="right"), n)
    for nearest in (np.maximum(half, least), least):
        for found in last:
            out = np.where((out < 0) & (found >= nearest), found, out)
    out = np.where(out < 0, reach, out)
    # Whatever fits as a whole is not cut.
    out[reach == n] = n
    return out


def cuts(step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All boundaries reached from those in first, by squaring the table of successors."""
    reached = np.zeros(len(step), bool)
    reached[first] = True
    while True:
        new = reached.copy()
        new[step[reached]] = True
        if np.array_equal(new, reached):
            return np.flatnonzero(reached)
        reached = new
        step = step[step]


def cut_batch(texts: list[str | None], limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = "words", folder: str = T.FOLDER) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, start_char, end_char, tokens) of the pieces of all texts, found together."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    own = T.load(tokenizer, folder)
    out: list[tuple[int, int, int, int, int]] = []
    rows, starts, first, steps, base, total = [], [], [], [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        # Texts that may well be whole are only counted.
        if len(text) <= 4 * limit and (n := own.count(text)) <= limit:
            out.append((row, 0, 0, len(text), n))
            continue
        s, whole = own.located(text)
        if len(s) <= limit:
            out.append((row, 0, 0, len(text), len(s)))
            continue
        rows.append(row)
        starts.append(s)
        first.append(begins(len(s), overlap, whole))
        steps.append(successors(boundaries(text, s, whole), limit, overlap, whole) + total)
        base.append(total)
        total += len(s) + 1
    if rows:
        found = cuts(np.concatenate(steps), np.array(base))
        own_cuts = np.split(found, np.searchsorted(found, base[1:]))
        for k, row in enumerate(rows):
            at = own_cuts[k] - base[k]
            s, text = starts[k], texts[row]
            for piece, (a, b) in enumerate(zip(at, at[1:])):
                begin = first[k][a]
                out.append((row, piece, int(s[begin]) if begin else 0, int(s[b]) if b < len(s) else len(text), int(b - begin)))
    return sorted(out)


def pieces(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = "words", folder: str = T.FOLDER, with_text: bool = True) -> DataFrame:
    """(doc_id, piece, start_char, end_char, tokens, text) of every document, in order; one map over the texts, no shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = b.column(1), b.column(0)
            for lo in range(0, b.num_rows, 256):
                own = texts.slice(lo, 256).to_pylist()
                found = cut_batch(own, limit, overlap, tokenizer, folder)
                if not found:
                    continue
                row, piece, start, end, n = zip(*found)
                text = [own[r][s:e] if with_text else None for r, s, e in zip(row, start, end)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, 256).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int32()), pa.array(text, pa.string())],
                    ["doc_id", "piece", "start_char", "end_char", "tokens", "text"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, SCHEMA)


def oversized(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id) of each document that must be cut, from its pieces."""
    return pieces(docs, limit, OVERLAP, "words", with_text=False).where("piece = 1").select("doc_id").distinct()


def invariants(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, chars, gaps, over_limit, without_overlap): characters the pieces of a document cover, and pieces that break a rule.

    gaps: pieces that begin beyond the end of the one before, or that don't move on; without_overlap: pieces that don't begin before that end.
    The pieces of one document lie in one window; doc_ids must be unique.
    """
    at = Window.partitionBy("doc_id").orderBy("piece")
    lined = pieces.withColumns({"end_before": F.lag("end_char").over(at), "start_before": F.lag("start_char").over(at)})
    later = F.col("end_before").isNotNull()
    broken = F.when(later, (F.col("start_char") > F.col("end_before")) | (F.col("start_char") <= F.col("start_before")) | (F.col("end_char") <= F.col("end_before"))).otherwise(F.col("start_char") != 0)
    fresh = F.col("end_char") - F.coalesce("end_before", F.lit(0))
    return lined.groupBy("doc_id").agg(F.sum(fresh).alias("chars"), F.count_if(broken).alias("gaps"), F.count_if(F.col("tokens") > limit).alias("over_limit"), F.count_if(later & (F.col("start_char") >= F.col("end_before"))).alias("without_overlap"))

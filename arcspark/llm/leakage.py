"""Evaluation texts inside a corpus (problem 6).

Wu-Manber search over words.  The patterns are all runs of RUN consecutive words of the items.  A shift
table over blocks of BLOCK words tells how far the scan may jump: a block that stands in no pattern lets it
skip RUN - BLOCK + 1 words at once, which is what nearly all positions of a corpus do; a block that ends some pattern
leads to the bucket of patterns with that suffix, and these are compared word by word.  Each text is scanned whole, once
for each block of items.

Items are a stated query set: they are broadcast in blocks of at most MAX_WORDS words, so their number isn't
bounded by a worker's memory.

Defined results: words are runs of letters and digits after NFKC and lower case, with words that a hyphen breaks at the end
of a line put together; a null or empty text has no words; an item shorter than RUN words, or null, is held by no document;
equal rows give one pair (doc_id, item_id); rows with a null id are left out; items with the same item_id count as one item
each and their pairs unite.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import counted

RUN = 12
BLOCK = 3
#: Share of an item's words that must be covered: 4 of 10.
SHARE = (4, 10)
#: Words of a block of items.  The tables of so many take about 140 MB and 3 s to build, once in each Python worker.
MAX_WORDS = 200_000
#: Items that leaked, up to which their counts are broadcast.
MAX_LEAKED = 200_000
WORD = re.compile(r"[^\W_]+")
#: A hyphen (also a soft one or U+2010) between letters at the end of a line.
BROKEN = re.compile(r"(?<=[^\W\d_])[-‐­][^\S\n\r]*(?:\r\n|\r|\n)\s*(?=[^\W\d_])")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\n" in text or "\r" in text:
        text = BROKEN.sub("", text)
    return WORD.findall(text.lower())


class Patterns:
    """Shift table, suffix buckets and items of one block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN, block: int = BLOCK):
        self.run, self.block, self.skip = run, block, run - block + 1
        self.words = [len(w) for _, w in items]
        self.ids = [i for i, _ in items]
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, dict[str, list[tuple[int, int]]]] = {}
        for nth, (_, w) in enumerate(items):
            for at in range(len(w) - run + 1):
                pattern = w[at : at + run]
                for end in range(block, run + 1):
                    key = " ".join(pattern[end - block : end])
                    self.shift[key] = min(self.shift.get(key, self.skip), run - end)
                suffix = " ".join(pattern[-block:])
                self.bucket.setdefault(suffix, {}).setdefault(" ".join(pattern), []).append((nth, at))

    def find(self, w: list[str]) -> list[int]:
        """item_ids of which enough words lie in runs that also stand in w."""
        run, block, skip, shift, bucket = self.run, self.block, self.skip, self.shift, self.bucket
        hits: dict[int, set[int]] = {}
        at, n, get = run, len(w), self.shift.get
        while at <= n:
            key = " ".join(w[at - block : at])
            s = get(key, skip)
            if s:
                at += s
                continue
            for nth, start in bucket[key].get(" ".join(w[at - run : at]), ()):
                hits.setdefault(nth, set()).add(start)
            at += 1
        out = []
        for nth, starts in hits.items():
            covered, end = 0, 0
            for s in sorted(starts):
                covered += s + run - max(s, end)
                end = s + run
            if covered * SHARE[1] >= self.words[nth] * SHARE[0]:
                out.append(self.ids[nth])
        return sorted(set(out))


_BUILT: dict[str, Patterns] = {}


def _patterns(key: str, items: list[tuple[int, list[str]]]) -> Patterns:
    """The tables of a block, built by the first task of a worker that needs them and kept until it meets another block."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Patterns(items)
    return _BUILT[key]


def _blocks(items: DataFrame, max_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items as words, in blocks of bounded size."""
    now, total = [], 0
    for row in items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").toLocalIterator():
        w = words(row["text"])
        if len(w) < RUN:
            continue
        if now and total + len(w) > max_words:
            yield now
            now, total = [], 0
        now.append((row["item_id"], w))
        total += len(w)
    if now:
        yield now


def leaks(docs: DataFrame, items: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, item_id): each document with each item of which it holds a copied part."""
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema, out = "doc_id bigint, item_id bigint", None
    for block in _blocks(items, max_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            patterns = _patterns(key, shared.value)
            for b in batches:
                ids, found = [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    for item in patterns.find(words(text.as_py())):
                        ids.append(doc)
                        found.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

        part = own.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.distinct()


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents): each item that leaked and in how many documents."""
    found, rows = counted(leaks(docs, items).groupBy("item_id").agg(F.count("*").alias("documents")), "leaked")
    names = items.groupBy("item_id").agg(F.min("suite").alias("suite"))
    return names.join(F.broadcast(found) if rows <= MAX_LEAKED else found, "item_id").select("item_id", "suite", "documents")

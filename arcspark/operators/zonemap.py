"""Elements, their filters, and zone maps that let blocks be skipped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import counted, shared_path
from .ingest import positions

BLOCK = 1024
NODE = 0
#: Largest zone map to broadcast, in rows; beyond it the blocks meet by a shuffle join.
MAX_BLOCKS = 1_000_000
#: Ranges of blocks that a pruned scan asks for; kept blocks that lie nearest each other share one.
MAX_RANGES = 128


@dataclass(frozen=True)
class Filter:
    """kind: equal; tag_mask: any of its bits, 0 for no test; bbox: (lat_min, lat_max, lon_min, lon_max) for nodes, bounds included."""

    kind: int | None = None
    tag_mask: int = 0
    bbox: tuple[int, int, int, int] | None = None

    def matches(self) -> Column:
        test = F.lit(True)
        if self.kind is not None:
            test = test & (F.col("kind") == self.kind)
        if self.tag_mask:
            test = test & (F.col("tag_flags").bitwiseAND(F.lit(self.tag_mask)) != 0)
        if self.bbox:
            a, b, c, d = self.bbox
            test = test & ((F.col("kind") != NODE) | (F.col("lat_e7").between(a, b) & F.col("lon_e7").between(c, d)))
        return test

    def might_match(self) -> Column:
        """Whether a block can hold a match; the box is tested only for a filter of nodes."""
        test = F.lit(True)
        if self.kind is not None:
            test = test & (F.col("kind_mask").bitwiseAND(F.lit(1 << self.kind)) != 0)
        if self.tag_mask:
            test = test & (F.col("tag_flags").bitwiseAND(F.lit(self.tag_mask)) != 0)
        if self.bbox and self.kind == NODE:
            a, b, c, d = self.bbox
            test = test & F.coalesce((F.col("lat_min") <= b) & (F.col("lat_max") >= a) & (F.col("lon_min") <= d) & (F.col("lon_max") >= c), F.lit(False))
        return test


def number(elements: DataFrame, order: str = "file_offset", block: int = BLOCK) -> DataFrame:
    """Elements with their place in file order and their block."""
    return positions(elements, [order], "elem_pos").withColumn("block_id", F.floor(F.col("elem_pos") / block))


def summaries(numbered: DataFrame) -> DataFrame:
    """One row for each block: its range, or of kind bits and flags, bounds of its nodes (null without nodes)."""
    node = F.col("kind") == NODE
    of = lambda f, c: f(F.when(node, F.col(c)))
    return numbered.groupBy("block_id").agg(
        F.min("elem_pos").alias("index_start"), (F.max("elem_pos") + 1).alias("index_end"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("kind").cast("int"))).alias("kind_mask"), F.bit_or("tag_flags").alias("tag_flags"),
        of(F.min, "lat_e7").alias("lat_min"), of(F.max, "lat_e7").alias("lat_max"), of(F.min, "lon_e7").alias("lon_min"), of(F.max, "lon_e7").alias("lon_max"),
    )


def filter_scan(elements: DataFrame, f: Filter) -> DataFrame:
    return elements.where(f.matches())


def store(numbered: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Numbered elements written in file order, a Parquet page for each block, so that a range of blocks can be read alone."""
    path = path or shared_path(numbered.sparkSession, "elements")
    lined = numbered.repartitionByRange("block_id").sortWithinPartitions("elem_pos")
    lined.write.option("parquet.page.row.count.limit", block).option("parquet.block.size", 16 << 20).parquet(path)
    return numbered.sparkSession.read.schema(numbered.schema).parquet(path)


def filter_pruned(stored: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """The same rows as filter_scan.  Of elements in a table made by store, only pages of blocks whose summary may match are read: the
    scan gets up to MAX_RANGES ranges of blocks as its filter.  Blocks inside a range that can't match meet by a semi join after it.
    """
    keep, n = counted(zones.where(f.might_match()).select("block_id"), "blocks")
    if not n:
        return stored.where(F.lit(False))
    lo, hi = keep.agg(F.min("block_id"), F.max("block_id")).first()
    width = max(1, -(-(hi - lo + 1) // MAX_RANGES))
    spans = keep.groupBy(F.floor((F.col("block_id") - lo) / width)).agg(F.min("block_id"), F.max("block_id")).collect()  # at most MAX_RANGES rows
    test = F.lit(False)
    for _, a, b in spans:
        test = test | F.col("block_id").between(a, b)
    rows = stored.where(test)
    if sum(b - a + 1 for _, a, b in spans) > n:
        rows = rows.join(F.broadcast(keep) if n <= MAX_BLOCKS else keep, "block_id", "left_semi")
    return rows.where(f.matches())


def counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("kind").agg(F.count("*").alias("elements"))

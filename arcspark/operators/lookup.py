"""Sorted keys: building, point and batch lookup; sorting by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import positions, prefix_sum


def by_key(df: DataFrame, key: str = "id", stable: str | None = None) -> DataFrame:
    """Rows in ascending order of a signed key: Spark's range partitioning is a sample sort.

    stable names the column of the input order that ties keep.
    """
    return df.orderBy(key, stable) if stable else df.orderBy(key)


def build(keys: DataFrame, key: str = "id") -> DataFrame:
    """(id, pos): each distinct key with the first place it has in sorted order.

    Places come from the distinct keys' counts, so repeated keys are never ordered one by one.
    """
    counted = keys.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("id")).agg(F.count("*").alias("n"))
    return prefix_sum(counted, ["id"], F.col("n"), "pos").select("id", "pos")


def find(index: DataFrame, key: int) -> DataFrame:
    """The place of one key as a row, none if it is missing; pushed to the sorted file's statistics."""
    return index.where(F.col("id") == key).select("pos")


def batch(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_pos, id, pos): every query in its order, with null where the key is missing."""
    return queries.join(index, "id", "left").select("query_pos", "id", "pos")


def near(queries: DataFrame, key: str = "id") -> DataFrame:
    """Queries sorted by key within their partitions, without a shuffle, so that each task asks neighbouring places one after the other."""
    return queries.sortWithinPartitions(key)


def rank(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    return positions(df, order, out)

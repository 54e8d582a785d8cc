"""Queries of the operators on training text and batch deduplication, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import history, leakage, packing, splitting, sql, tokens

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(table(spark, d, "chunk_index"))


def p5_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(packing.pack(table(spark, d, "documents")))


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any packing, with sizes by the word rule, which SQL can count: what is packed, and rows that break a rule."""
    return packing.invariants(packing.pack(table(spark, d, "documents"), tokenizer="words"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "documents"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"), tokenizer=tokens.NAME)


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What holds of the pieces of each document: the characters they cover, and pieces that break a rule."""
    return splitting.invariants(splitting.pieces(table(spark, d, "documents"), tokenizer=tokens.NAME))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p5_packed, p5_report, p5_invariants, p6_found, p6_items, p7_found, p7_pieces, p7_invariants)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()

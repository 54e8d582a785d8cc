"""Windows over event time, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour", time: str = "ts", by: tuple[str, ...] = (), value: str | None = None, late: str | None = None) -> DataFrame:
    """(window_start, by..., events, total): counts, and sums of value, in fixed windows; late bounds a stream's state."""
    own = events.withWatermark(time, late) if late else events
    sums = [F.sum(value).alias("total")] if value else []
    return own.groupBy(F.window(time, size), *by).agg(F.count("*").alias("events"), *sums).select(F.col("window.start").alias("window_start"), *by, "events", *(["total"] if value else []))


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", by: str = "user_id", late: str | None = None) -> DataFrame:
    """(by, session_start, session_end, events): runs of events at most gap apart."""
    own = events.withWatermark(time, late) if late else events
    return own.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("events")).select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def distinct_within(events: DataFrame, late: str, time: str = "ts", keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """A stream without repetitions of keys that arrive within late of each other."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))

"""Streams: run outcomes that arrive more than once, and counts of events by window (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesce_outcomes(outcomes: DataFrame, revision: str = "outcome_revision", payload: str = "payload") -> DataFrame:
    """One row a revision. Equal copies count once; a revision with different payloads is withheld (``payload`` null)."""
    found = outcomes.groupBy(revision).agg(F.min(payload).alias("low_"), F.max(payload).alias("high_"), F.count("*").alias("copies"), F.count(payload).alias("given_"))
    same = F.col("low_").eqNullSafe(F.col("high_")) & ((F.col("given_") == F.col("copies")) | (F.col("given_") == 0))
    return found.select(revision, F.when(same, F.col("low_")).alias(payload), "copies", (~same).alias("withheld"))


def _timed(events: DataFrame, at: str, late: str) -> DataFrame:
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late) if timed.isStreaming else timed


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events by window and type; windows follow each other, or start every ``slide``.

    Works on a stream (late rows dropped beyond ``late``) and on a table.
    """
    timed = _timed(events, at, late)
    return timed.groupBy(F.window(at, width, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, key: str, at: str = "ts", late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """``key, start, end, n``: events of a key that follow each other within ``gap``."""
    found = _timed(events, at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_outcomes(stream: DataFrame, revision: str = "outcome_revision", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each revision once, as soon as it comes; copies that follow within ``late`` are dropped (on a table: all copies)."""
    timed = _timed(stream, at, late)
    return timed.dropDuplicatesWithinWatermark([revision]) if timed.isStreaming else timed.dropDuplicates([revision])

"""Structured Streaming forms of the periodic jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .months import monthly_totals
from .retries import keep_results, outcomes, retry_results, to_try_again
from .tables import clear_old, read_current, upsert

__all__ = ["append_log", "clear_old", "keep_results", "monthly_counts", "monthly_totals", "outcomes", "read_current", "retry_results", "to_try_again", "upsert", "weekly_counts"]


def weekly_counts(events: DataFrame, ts: str = "ts", group: str = "event_type", late: str = "14 days") -> DataFrame:
    """Counts by Monday week; the offset is there because windows start from a Thursday, 1970-01-01."""
    w = F.window(ts, "7 days", "7 days", "4 days")
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), group).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("week"), group, "n", "total")


def monthly_counts(events: DataFrame, ts: str = "ts", group: str = "event_type") -> DataFrame:
    """Counts by calendar month, which no fixed window is, for tables, or streams in complete mode.

    A stream's state holds a row for each month and group for ever; ``monthly_totals`` closes its months.
    """
    month = F.date_trunc("month", F.col(ts)).cast("date").alias("month")
    return events.groupBy(month, group).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append_log(rows: DataFrame, path: str, checkpoint: str):
    """All that is there now, appended as JSON lines; a later run goes on from there."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

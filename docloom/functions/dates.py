"""Dates, weeks, months and durations as they are written in documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MONTHS = ("leden", "únor", "březen", "duben", "květen", "červen", "červenec", "srpen", "září", "říjen", "listopad", "prosinec")


def czech_date(d: Column) -> Column:
    """``9. 11. 2026`` without padding."""
    return F.date_format(d, "d. M. yyyy")


def from_czech_date(x: Column) -> Column:
    """The first date such as ``9. 11. 2026`` in a text; null without one, or if there is no such day."""
    part = lambda i: F.regexp_extract(x, r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})", i)
    return F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")).try_cast("date")


def month_title(prefix: str, d: Column) -> Column:
    """``prefix, leden 2014``."""
    return F.concat(F.lit(f"{prefix}, "), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(d)), F.lit(" "), F.year(d).cast("string"))


def iso_week(d: Column) -> Column:
    """``2026-T46``: ISO year and week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-T"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def duration(seconds: Column) -> Column:
    """``mm:ss``, or ``h:mm:ss`` from an hour on."""
    s = seconds.cast("int")
    h, m, r = (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60
    short = F.format_string("%02d:%02d", m, r)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(short)


def to_utc(x: Column) -> Column:
    """An instant from a text with an offset, in UTC; null for any other text."""
    return F.when(x.rlike(r"^\s*\d{4}-\d\d-\d\d"), F.try_to_timestamp(x))


def recent(d: Column, today: Column, days: int = 14) -> Column:
    """Whether something is younger than ``days``, so that a missing part is worth another try."""
    return F.datediff(today, d) < days


def days_after(issued: Column, effective: Column) -> Column:
    """Calendar days from the day of issue to the effective day: negative where the record came first."""
    return F.date_diff(effective.cast("date"), issued.cast("date"))

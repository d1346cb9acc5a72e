"""Totals of calendar months from a stream, each given out once, when its month is over.

No window function of streams is a calendar month, so each month and group has a state of its own: a count, a sum and a
timer at the month's end.  When the watermark passes it, the total comes out and the state ends; so state is bounded by the
months that are open.  Events that come in after their month was closed go out with ``late``, as totals of what came late.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .retries import use_timers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as in retries
_OUT = "month date, {group} string, n long, total double, late boolean"


class MonthlyTotals(StatefulProcessor):
    """Rows are sums of a batch's events of one month and group; ``ends`` is the month's end in milliseconds."""

    def __init__(self, group: str):
        self.group = group

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, total double")

    def _frame(self, key, n: int, total: float, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"month": [key[0]], self.group: [key[1]], "n": [n], "total": [total], "late": [late]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, total, ends = 0, 0.0, 0
        for part in rows:
            n, total, ends = n + len(part), total + float(part["value"].fillna(0).sum()), int(part["ends"].iloc[0])
        if ends <= timerValues.getCurrentWatermarkInMs():
            yield self._frame(key, n, total, True)
            return
        old = self.sums.get()
        if old is None:
            self.handle.registerTimer(ends)
            old = (0, 0.0)
        self.sums.update((old[0] + n, old[1] + total))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, total = self.sums.get()
        self.sums.clear()
        yield self._frame(key, n, total, False)

    def close(self) -> None:
        pass


def monthly_totals(events: DataFrame, ts: str = "ts", group: str = "event_type", value: str = "value", delay: str = "1 day") -> DataFrame:
    """A stream of ``month, group, n, total, late`` from a stream of events; the clock runs ``delay`` behind them."""
    use_timers(events.sparkSession)
    marked = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    month = F.date_trunc("month", F.col(ts))
    # As plain columns: Spark would drop rows behind the watermark.
    rows = marked.select(month.cast("date").alias("month"), F.col(group).cast("string").alias(group), F.col(value).cast("double").alias("value"), F.unix_millis(F.add_months(month.cast("date"), 1).cast("timestamp")).alias("ends"))
    return rows.filter("month is not null").groupBy("month", group).transformWithStateInPandas(MonthlyTotals(group), _OUT.format(group=group), "Append", "EventTime")

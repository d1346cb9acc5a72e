"""Subtitles that may come late: each video is tried again until it has them or is two weeks old.

A row is one try: ``video, published, fetched, subtitles`` (null where there were none).  A video's window ends
``days`` after its publication.  Its state holds the number of tries and the first try that found subtitles, and a timer;
when the watermark passes the end of the window, the video's result comes out and the state ends, so state is bounded by
the videos of two weeks.  Nothing is dropped silently: tries after the window, or that come when it has been closed, and
rows without a video or a time go to a side table.

Results do not depend on the order of rows or on how they fall into batches, but for rows that come in after the
watermark: ``outcomes`` gives the same from a whole table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

DAYS, DELAY = 14, "1 day"
DAY_MS = 86_400_000
#: ``kind`` is found (a try that had subtitles, the first so far), closed (a video's result) or late (the side table).
RESULT = "kind string, video string, published timestamp, fetched timestamp, tries long, subtitles string, reason string"
_ROW = "kind string, video string, published long, fetched long, tries long, subtitles string, reason string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
# The driver's own Python worker for state gets no shipped files, so processors travel whole, not by name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """The state store that timers need, for the streams that a session starts from now on."""
    spark.conf.set(_STORE, _ROCKS)


def _row(kind: str, video: str | None, published: int | None, fetched: int | None, tries: int | None = None, subtitles: str | None = None, reason: str | None = None) -> Row:
    return Row(kind=kind, video=video, published=published, fetched=fetched, tries=tries, subtitles=subtitles, reason=reason)


class Retries(StatefulProcessor):
    """One video's tries; times are milliseconds."""

    def __init__(self, window_ms: int = DAYS * DAY_MS):
        self.window_ms = window_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "published long, tries long, found long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        video, now = key[0], timerValues.getCurrentWatermarkInMs()
        published, tries, found = self.seen.get() or (None, 0, None)
        before = published
        for r in rows:
            if video is None or r.published is None or r.fetched is None:
                yield _row("late", video, r.published, r.fetched, subtitles=r.subtitles, reason="incomplete")
                continue
            start = r.published if published is None else min(published, r.published)
            if r.fetched >= start + self.window_ms:
                yield _row("late", video, r.published, r.fetched, subtitles=r.subtitles, reason="after the window")
            elif start + self.window_ms <= now:
                yield _row("late", video, r.published, r.fetched, subtitles=r.subtitles, reason="already closed")
            else:
                published, tries = start, tries + 1
                if r.subtitles is not None and (found is None or r.fetched < found):
                    found = r.fetched
                    yield _row("found", video, published, found, subtitles=r.subtitles)
        if published is None:
            return
        self.seen.update((published, tries, found))
        if published != before:
            if before is not None:
                self.handle.deleteTimer(before + self.window_ms)
            self.handle.registerTimer(published + self.window_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        published, tries, found = self.seen.get()
        self.seen.clear()
        yield _row("closed", key[0], published, found, tries=tries)

    def close(self) -> None:
        pass


def _millis(x: Column) -> Column:
    return F.unix_millis(x.cast("timestamp"))


def _typed(rows: DataFrame) -> DataFrame:
    at = lambda c: F.timestamp_millis(c).alias(c)
    return rows.select("kind", "video", at("published"), at("fetched"), "tries", "subtitles", "reason")


def retry_results(tries: DataFrame, days: int = DAYS, delay: str = DELAY) -> DataFrame:
    """A stream of ``RESULT`` rows from a stream of tries; ``fetched`` moves the clock, ``delay`` behind the latest."""
    use_timers(tries.sparkSession)
    marked = tries.withColumn("fetched", F.col("fetched").cast("timestamp")).withWatermark("fetched", delay)
    # As plain numbers: Spark would drop rows behind the watermark, which belong in the side table.
    rows = marked.select(F.col("video").cast("string").alias("video"), _millis(F.col("published")).alias("published"), _millis(F.col("fetched")).alias("fetched"), "subtitles")
    return _typed(rows.groupBy("video").transformWithState(Retries(days * DAY_MS), _ROW, "Append", "EventTime"))


def outcomes(tries: DataFrame, days: int = DAYS, delay_ms: int = DAY_MS) -> DataFrame:
    """What ``retry_results`` has given out once all of ``tries`` came in order: ``kind`` closed and late, from a table.

    The clock stands ``delay_ms`` before the latest try.
    """
    window = days * DAY_MS
    rows = tries.select(F.col("video").cast("string").alias("video"), _millis(F.col("published")).alias("published"), _millis(F.col("fetched")).alias("fetched"), "subtitles")
    whole = rows.filter("video is not null and published is not null and fetched is not null")
    clock = whole.agg((F.max("fetched") - delay_ms).alias("clock"))  # one row
    start = whole.groupBy("video").agg(F.min("published").alias("start"))
    dated = whole.join(start, "video")
    inside = dated.filter(F.col("fetched") < F.col("start") + window)
    closed = inside.groupBy("video").agg(F.min("start").alias("published"), F.count("*").alias("tries"), F.min(F.when(F.col("subtitles").isNotNull(), F.col("fetched"))).alias("fetched"))
    closed = closed.crossJoin(F.broadcast(clock)).filter(F.col("published") + window <= F.col("clock"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("subtitles", "reason")]
    late = dated.filter(F.col("fetched") >= F.col("start") + window).withColumn("reason", F.lit("after the window"))
    late = late.unionByName(rows.filter("video is null or published is null or fetched is null").withColumn("reason", F.lit("incomplete")), allowMissingColumns=True)
    side = late.select(F.lit("late").alias("kind"), "video", "published", "fetched", F.lit(None).cast("long").alias("tries"), "subtitles", "reason")
    return _typed(closed.select(F.lit("closed").alias("kind"), "video", "published", "fetched", "tries", *nothing).unionByName(side))


def to_try_again(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``video, published, tries`` of the videos that the next run should try: in their window and without subtitles.

    Read from the stream's state.
    """
    state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    return state.select(F.col("key.video").alias("video"), F.timestamp_millis("value.published").alias("published"), F.col("value.tries").alias("tries"), "value.found").filter("found is null").drop("found")


def keep_results(path: str, buckets: int = 64):
    """A ``foreachBatch`` function: subtitles to an upserted table, results and late rows to folders of each batch.

    A batch that is done again overwrites its own folders.
    """
    from .tables import upsert

    subtitles = upsert(f"{path}/subtitles", ["video"], ["earlier"], buckets)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for kind in ("closed", "late"):
                batch.filter(F.col("kind") == kind).write.mode("overwrite").parquet(f"{path}/{kind}/batch={batch_id}")
            # The earliest try that found something is the one to keep.
            found = batch.filter("kind = 'found'").select("video", "fetched", "subtitles", (-_millis(F.col("fetched"))).alias("earlier"))
            subtitles(found, batch_id)
        finally:
            batch.unpersist()

    return run

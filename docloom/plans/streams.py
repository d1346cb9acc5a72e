"""Queries on what changes in time: late subtitles, as a table and as a stream, and resolutions in force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import in_force as I
from ..store import fresh_path
from ..streaming.retries import outcomes, retry_results
from ._base import Registry, table

q = Registry()

#: A video for each user and month: published as the month begins; each event of the month is a try.
_RETRIES = """
WITH t AS (SELECT concat(CAST(user_id AS VARCHAR), '-', strftime(ts, '%Y-%m')) AS video, date_trunc('month', ts) AS published, date_trunc('millisecond', ts) AS fetched, event_type = 'signup' AS found FROM events),
c AS (SELECT max(fetched) - INTERVAL 1 DAY AS clock FROM t),
i AS (SELECT * FROM t WHERE fetched < published + INTERVAL 14 DAY)
SELECT 'closed' AS kind, video, CAST(count(*) AS BIGINT) AS n, min(fetched) FILTER (WHERE found) AS first_found FROM i, c GROUP BY video, clock HAVING min(published) + INTERVAL 14 DAY <= clock
UNION ALL SELECT 'late', video, count(*), NULL FROM t WHERE fetched >= published + INTERVAL 14 DAY GROUP BY video"""


def _tries(events):
    month = F.date_trunc("month", "ts").cast("timestamp")
    return events.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(month, "yyyy-MM")).alias("video"), month.alias("published"), F.col("ts").cast("timestamp").alias("fetched"), F.when(F.col("event_type") == "signup", F.col("event_type")).alias("subtitles"))


def _told(results):
    rows = results.filter("kind in ('closed', 'late')").groupBy("kind", "video").agg(F.sum(F.coalesce("tries", F.lit(1))).cast("long").alias("n"), F.max(F.when(F.col("kind") == "closed", F.col("fetched"))).cast("timestamp_ntz").alias("first_found"))
    return rows.select("kind", "video", "n", "first_found")


@q(_RETRIES)
def late_subtitles(spark, d):
    return _told(outcomes(_tries(table(spark, d, "events"))))


@q(_RETRIES)
def late_subtitles_stream(spark, d):
    """The same from a stream with state and timers, run until all of the table has been read."""
    schema, path = table(spark, d, "events").schema, fresh_path(spark, "retries")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    run = retry_results(_tries(events)).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/check")
    run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _told(spark.read.parquet(f"{path}/rows"))


#: Resolution i of a day revokes, if i is no multiple of 3, resolution i // 2 by number and date.
_CHAINS = """
WITH RECURSIVE e AS (SELECT event_id AS id, CAST(ts AS DATE) AS date, CASE WHEN event_id % 3 > 0 THEN event_id // 2 END AS revokes FROM events),
o AS (SELECT r.revokes AS id, arg_min(r.id, struct_pack(d := r.date, i := r.id)) AS later FROM e r JOIN e a ON a.id = r.revokes AND (r.date > a.date OR r.date = a.date AND r.id > a.id) GROUP BY 1),
c AS (SELECT id, id AS at, 0 AS steps FROM e UNION ALL SELECT c.id, o.later, c.steps + 1 FROM c JOIN o ON o.id = c.at),
v AS (SELECT c.id, steps, date AS since, lead(date) OVER (PARTITION BY c.id ORDER BY steps) AS until FROM c JOIN e ON e.id = c.at),
w AS (SELECT id, since, until FROM v WHERE steps % 2 = 0 AND (until IS NULL OR until > since))"""


def _resolutions(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("date"))
    target = F.when(F.col("id") % 3 > 0, F.floor(F.col("id") / 2))
    named = e.select(F.col("id").alias("_target"), dates.czech_date(F.col("date")).alias("day"))
    title = F.concat(F.lit("K revokaci usnesení rady č. "), F.col("_target").cast("string"), F.lit(" ze dne "), F.col("day"))
    return e.withColumn("_target", target).join(named, "_target", "left").select("id", F.lit("RV").alias("body"), F.col("id").cast("string").alias("number"), "date", title.alias("title"))


@q(_CHAINS + " SELECT id, since, until FROM w")
def in_force_intervals(spark, d):
    rows = _resolutions(spark, d)
    return I.validity(rows, I.references(rows))


@q(_CHAINS + " SELECT e.id, NOT EXISTS (SELECT 1 FROM w, (SELECT min(date) + INTERVAL 15 DAY AS day FROM e) WHERE w.id = e.id AND since <= day AND (until IS NULL OR until > day)) AS warned FROM e")
def in_force_warnings(spark, d):
    rows = _resolutions(spark, d)
    day = rows.agg(F.date_add(F.min("date"), 15).alias("day"))  # one row
    told = I.with_warning(rows.crossJoin(F.broadcast(day)), I.validity(rows, I.references(rows)).crossJoin(F.broadcast(day)), F.col("day"))
    return told.select("id", F.col("warning").isNotNull().alias("warned"))


QUERIES, SQL = q.queries, q.sql

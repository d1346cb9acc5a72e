"""Monthly pages of media items and posts: a head with a count and a note of whose words they are, then days with items.

``items`` has id, ts, title, medium, url, people (names in order) and authority.  A page is rows of lines, numbered from 1, so
that a page of any length is never one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates

#: What a page says of its items, by their authority.
NOTES = {
    "externi-media": "Jde o cizí texty (mohou být kritické i nepřesné), ne o výstup strany.",
    "vyjadreni-politika": "Jde o vlastní vyjádření politika, ne o stanovisko strany.",
}


def disclaimer(authority: Column) -> Column:
    """The note that items of an authority need; null where they speak for the party."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair]), authority)


def numbered(rows: DataFrame, keys: Sequence[str], parts: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with numbers from 1 within ``keys``, by ``parts`` and then ``order``.

    Rows are sorted within each part and moved by the number of rows in earlier ones, so no task sorts a whole group.
    Keys and parts are not null.
    """
    cut = [f"_part{i}" for i in range(len(parts))]
    cut_rows = rows.select("*", *[p.alias(c) for c, p in zip(cut, parts, strict=True)])
    counts = cut_rows.groupBy(*keys, *cut).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, *cut).orderBy(*order))
    return cut_rows.withColumn("_own", own).join(moved, [*keys, *cut]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", *cut)


def heads(items: DataFrame) -> DataFrame:
    """``month, authority, n, latest, days, note`` of each page; items without a time have none."""
    dated = items.filter("ts is not null").select(F.trunc(F.to_date("ts"), "month").alias("month"), F.coalesce("authority", F.lit("")).alias("authority"), F.to_date("ts").alias("day"))
    days = dated.groupBy("month", "authority", "day").agg(F.count("*").alias("n"))
    return days.groupBy("month", "authority").agg(F.sum("n").alias("n"), F.max("day").alias("latest"), F.count("*").alias("days")).withColumn("note", disclaimer(F.col("authority")))


def _item(people: Column) -> Column:
    said = F.when(F.size(people) > 0, F.concat(F.lit(" · zmíněni: "), F.array_join(people, ", "))).otherwise("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(F.lit("- **"), text("title"), F.lit("** ("), text("medium"), F.lit(") [odkaz]("), text("url"), F.lit(")"), F.coalesce(said, F.lit("")))


def lines(items: DataFrame) -> DataFrame:
    """``month, authority, line, text``: the days of each page from the last to the first, each day's items by time, then id.

    A day has a heading of its own before its items.
    """
    day = F.to_date("ts")
    rows = items.filter("ts is not null").select(F.trunc(day, "month").alias("month"), F.coalesce("authority", F.lit("")).alias("authority"), day.alias("day"), F.col("ts").cast("timestamp").alias("ts"), F.col("id"), _item(F.col("people")).alias("text"))
    days = rows.select("month", "authority", "day").distinct().select("*", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.concat(F.lit("### "), dates.czech_date(F.col("day"))).alias("text"))
    back = F.datediff(F.lit("9999-12-31").cast("date"), F.col("day"))
    hour = F.when(F.col("ts").isNull(), -1).otherwise(F.hour("ts"))
    both = numbered(rows.unionByName(days), ["month", "authority"], [back, hour], [F.asc_nulls_first("ts"), F.asc("id"), F.asc("text")], "line")
    return both.select("month", "authority", "line", "text")


def write_pages(page_lines: DataFrame, path: str) -> None:
    """A folder of text for each month and authority; the lines of a page stand in order of the files."""
    named = page_lines.select(F.date_format("month", "yyyy-MM").alias("page"), "authority", "line", "text")
    dealt = named.repartitionByRange("page", "authority", "line").sortWithinPartitions("page", "authority", "line")
    dealt.select("page", "authority", F.col("text").alias("value")).write.mode("overwrite").partitionBy("page", "authority").text(path)

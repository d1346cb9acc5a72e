"""Which resolution is in force at a date, when resolutions revoke others and revocations are revoked in turn.

A resolution has ``body, number, date``.  References are read from titles (``K revokaci usnesení č. 931 ze dne
13. 5. 2019``) and notes (``zrušeno usnesením … [RV 17/2013]``) and found again by equality of body, number and, where
it is named, date.  Of several that revoke the same one the first counts.  A resolution is in force from its date until
its revoker's; again from the date of the revoker's own revoker until that of the next; and so on.

Chains are followed by pointer jumping: rounds of joins over 1, 2, 4, ... steps on written tables.  A revoker must be
later than what it revokes (by date, then by its key), so there are no cycles; other references come out of ``references``
but do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..store import materialize, release

_NUMBER = r"\d+(?:/\d+)*"


def revokes(title: Column) -> Column:
    """(number, date) of the resolution that a title revokes; nulls without one, the date also where none is named."""
    part = rf"(?i)(?:revokac|zrušen|zruš)\S*\s+(?:\S+\s+){{0,6}}?usnesení\b[^0-9]{{0,80}}?({_NUMBER})(?:[^0-9]{{0,20}}?ze dne ([0-9]{{1,2}}\.\s*[0-9]{{1,2}}\.\s*[0-9]{{4}}))?"
    got = lambda i: F.nullif(F.regexp_extract(title, part, i), F.lit(""))
    return F.struct(got(1).alias("number"), dates.from_czech_date(got(2)).alias("date"))


def revoked_by(note: Column) -> Column:
    """(body, number) of the resolution that a note names as the revoking one, such as ``RV 17/2013``."""
    part = rf"(?i:zrušen\S*\s+usnesením)[^\[\n]{{0,80}}?\[?\b([A-ZÁ-Ž]{{1,6}})\s+({_NUMBER})"
    got = lambda i: F.nullif(F.regexp_extract(note, part, i), F.lit(""))
    return F.struct(got(1).alias("body"), got(2).alias("number"))


def references(rows: DataFrame, title: str = "title", note: str | None = None) -> DataFrame:
    """``revoker, revoked, counts``: the ids (column ``id``) of resolutions that revoke others, as titles and notes say.

    ``counts`` is false for one that is not later than what it names, and for all but the first of several.
    """
    known = rows.select("id", "body", "number", F.col("date").cast("date").alias("date"))
    ask = rows.select(F.col("id").alias("revoker"), F.col("body").alias("_body"), revokes(F.col(title)).alias("r")).filter("r.number is not null")
    there = (F.col("body") == F.col("_body")) & (F.col("number") == F.col("r.number")) & (F.col("r.date").isNull() | (F.col("date") == F.col("r.date")))
    pairs = ask.join(known, there).select("revoker", F.col("id").alias("revoked"))
    if note is not None:
        said = rows.select(F.col("id").alias("revoked"), revoked_by(F.col(note)).alias("r")).filter("r.number is not null")
        pairs = pairs.unionByName(said.join(known, (F.col("body") == F.col("r.body")) & (F.col("number") == F.col("r.number"))).select(F.col("id").alias("revoker"), "revoked"))
    at = lambda c: known.select(F.col("id").alias(c), F.col("date").alias(f"{c}_date"))
    dated = pairs.distinct().join(at("revoker"), "revoker").join(at("revoked"), "revoked")
    later = F.struct("revoker_date", "revoker") > F.struct("revoked_date", "revoked")
    first = dated.filter(later).groupBy("revoked").agg(F.min(F.struct("revoker_date", "revoker")).alias("first")).select("revoked", F.col("first.revoker").alias("_first"))
    return dated.join(first, "revoked", "left").select("revoker", "revoked", F.coalesce(F.col("revoker") == F.col("_first"), F.lit(False)).alias("counts"))


def chains(edges: DataFrame) -> DataFrame:
    """``id, later, steps``: everything that stands above a resolution in its chain, from ``revoked, revoker``."""
    one = edges.select(F.col("revoked").alias("id"), F.col("revoker").alias("later"))
    known = materialize(one.withColumn("steps", F.lit(1)), "chains")  # up to ``reach`` steps
    jump = materialize(one, "jumps")  # exactly ``reach`` steps
    reach = 1
    while True:
        on = known.select(F.col("id").alias("later"), F.col("later").alias("next"), "steps")
        further = materialize(jump.join(on, "later").select("id", F.col("next").alias("later"), (F.col("steps") + reach).alias("steps")), "chains")
        if further.isEmpty():
            release(jump, further)
            return known
        both = materialize(known.unionByName(further), "chains")
        again = materialize(jump.join(jump.select(F.col("id").alias("later"), F.col("later").alias("next")), "later").select("id", F.col("next").alias("later")), "jumps")
        release(known, further, jump)
        known, jump, reach = both, again, reach * 2


def validity(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, since, until``: a row for each time in which a resolution is in force; ``until`` is exclusive, null is open.

    ``edges`` are ``references``; a time without a day is left out.
    """
    at = rows.select("id", F.col("date").cast("date").alias("date"))
    own = at.select("id", F.lit(0).alias("steps"), "date")
    above = chains(edges.filter("counts").select("revoked", "revoker")).join(at.select(F.col("id").alias("later"), "date"), "later").select("id", "steps", "date")
    w = Window.partitionBy("id").orderBy("steps")  # as many rows as its chain is long
    times = own.unionByName(above).withColumn("until", F.lead("date").over(w)).filter("steps % 2 = 0")
    return times.filter("date is not null and (until is null or until > date)").select("id", F.col("date").alias("since"), "until")


def in_force(valid: DataFrame, at: Column) -> DataFrame:
    """The ids in force at a day."""
    return valid.filter((F.col("since") <= at) & (F.col("until").isNull() | (F.col("until") > at))).select("id").distinct()


def with_warning(rows: DataFrame, valid: DataFrame, at: Column) -> DataFrame:
    """``rows`` (by ``id``) with ``warning``: null in force, else since when it is not, or that it is not yet."""
    told = valid.groupBy("id").agg(F.max(F.when((F.col("since") <= at) & (F.col("until").isNull() | (F.col("until") > at)), F.lit(1))).alias("_now"), F.max(F.when(F.col("until") <= at, F.col("until"))).alias("_ended"))
    text = F.when(F.col("_now") == 1, None).when(F.col("_ended").isNotNull(), F.concat(F.lit("Neplatné od "), dates.czech_date(F.col("_ended")))).otherwise(F.lit("Dosud neplatné"))
    return rows.join(told, "id", "left").withColumn("warning", text).drop("_now", "_ended")
